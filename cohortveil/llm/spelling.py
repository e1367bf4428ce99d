"""Grouping of spelling variants: words one edit apart, found by search schemes on FM-indexes.

Words are counted over all documents in Spark.  A word is cut in two halves; a
word one edit away holds one half whole.  Both are dealt by that half (with the
length that the asking word has), so a task indexes and asks the words of some
halves: it sorts the prefixes of its words from their last character back, which
is the FM-index of the delimited words read from the end, narrows each asking
word's interval of ranks by its whole half, goes on through the other half with
one inserted, left out or replaced character, and takes the words that end
there.  For the second half's sake the same is done with all words reversed.

A half that too many words share is dealt again by quarters (the error lies in
one, all around it is whole), then by eighths, so no task holds all of a hot
half.  A pair counts in the part that holds its last possible place, once.

A null or empty text has no words; repeated rows count as often as they stand.
Words are at least two characters long.  Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one part that are dealt to one task at most, and how often parts are halved to that end.
MOST, DEPTHS = 200_000, 3
#: Words dealt to a task, and asked together.
_PER_TASK, _TOGETHER = 150_000, 20_000


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2, slip_every: int = 31) -> DataFrame:
    """``word, n``: runs of letters in small ones (A-Z only) that are long and frequent enough.

    One run of about ``slip_every`` loses a character, by the hash of its document's id and itself (0: none does).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)  # a shorter one stays too short
    small = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    words = runs.select("id", small.alias("word"))
    if slip_every:
        told = words.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "UTF-8")))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = told.select(F.when(F.col("h") % slip_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _part(asking: Column, part: int, parts: int) -> Column:
    """What a word must share to be asked for with an error in this part: a hash of the asking word's length and all around the part."""
    length = F.length("word")
    low, high = (F.floor(asking * k / parts).cast("int") for k in (part, part + 1))
    rest = asking - high
    return F.xxhash64(F.lit(parts), F.lit(part), asking, F.substring(F.col("word"), F.lit(1), low), F.substring(F.col("word"), length - rest + 1, rest))


def _dealt(words: DataFrame, depth: int) -> DataFrame:
    """``word, n, asks, parts, part, key, parent``: a row for each part and each length that an asking word may have."""
    parts, length, out = 1 << depth, F.length("word"), []
    for more in (-1, 0, 1):
        asking = length + more
        out += [F.struct(F.lit(more == 0).alias("asks"), F.lit(parts).alias("parts"), F.lit(part).alias("part"), _part(asking, part, parts).alias("key"), (_part(asking, part // 2, parts // 2) if depth > 1 else F.lit(0).cast("long")).alias("parent")) for part in range(parts)]
    return words.select("word", "n", F.explode(F.array(*out)).alias("d")).select("word", "n", "d.*")


def _split(words: DataFrame, most: int) -> DataFrame:
    """Rows of :func:`_dealt`, those of parts that over ``most`` words share by parts of half their length."""
    rows, out = _dealt(words, 1), []
    for depth in range(1, DEPTHS + 1):
        hot = checkpointed(rows.groupBy("key").count().where(F.col("count") > most).select("key")) if depth < DEPTHS else None
        if hot is None or hot.isEmpty():
            out.append(rows)
            break
        out.append(rows.join(hot, "key", "left_anti"))
        rows = _dealt(words, depth + 1).join(hot.select(F.col("key").alias("parent")), "parent", "left_semi")
    columns = ("word", "n", "asks", "parts", "part", "key")
    return reduce(DataFrame.unionByName, [r.select(*columns) for r in out])


class _Index:
    """FM-index of words given as rows of codes from 1 up, each narrowed from its first character on."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.codes, self.starts, self.lengths = codes, starts, lengths
        sizes = lengths + 1
        n = int(sizes.sum())
        word = np.repeat(np.arange(len(lengths)), sizes)
        nth = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # characters before the place
        before = np.zeros(n, np.int64)
        before[nth > 0] = codes
        after = np.zeros(n, np.int64)
        after[nth < lengths[word]] = codes
        rank, reach, longest = before, 1, int(lengths.max(initial=0))
        while reach < longest:  # places by their last `reach` characters, then by twice as many
            further = np.zeros(n, np.int64)
            far = np.flatnonzero(nth >= reach)
            further[far] = rank[far - reach] + 1
            key = rank * (n + 2) + further
            order = np.argsort(key, kind="stable")
            changed = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = changed
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.size, self.symbols = n + 1, int(codes.max(initial=0))
        self.next, self.word = after[order], word[order]
        places = np.argsort(self.next, kind="stable")
        self.sorted = self.next[places] * self.size + places

    def step(self, code: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where a bound of an interval goes if the character follows."""
        return np.searchsorted(self.sorted, code * self.size + rank)

    def followed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of intervals and the characters that follow in them, each once."""
        wide = high - low > self.symbols
        few = np.flatnonzero(~wide)
        sizes = (high - low)[few]
        of = np.repeat(few, sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        pairs = np.unique(of * (self.symbols + 1) + self.next[at])
        many = (np.flatnonzero(wide)[:, None] * (self.symbols + 1) + np.arange(1, self.symbols + 1)).ravel()
        pairs = np.concatenate((pairs, many))
        of, code = np.divmod(pairs, self.symbols + 1)
        return of[code > 0], code[code > 0]

    def one_off(self, asked: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words (asked, found): one edit apart at one of the asked word's places from ``first`` to ``last`` (after it, for an insertion)."""
        starts, lengths = self.starts[asked], self.lengths[asked]
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), self.size - 1)
        high[:] = len(self.lengths)  # places before any character come first, one a word
        states: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(int(last.max(initial=-1)) + 1):
            inside = np.flatnonzero((t >= first) & (t <= last))
            if len(inside):
                of, code = self.followed(low[inside], high[inside])
                q = inside[of]
                own = np.where(t < lengths[q], self.codes[np.minimum(starts[q] + t, len(self.codes) - 1)], 0)
                lo, hi = self.step(code, low[q]), self.step(code, high[q])
                there = hi > lo
                states.append((q[there], np.full(int(there.sum()), t), lo[there], hi[there]))  # one more character
                there &= (t < lengths[q]) & (t < last[q]) & (code != own)
                states.append((q[there], np.full(int(there.sum()), t + 1), lo[there], hi[there]))  # another one
                out = inside[(t < lengths[inside]) & (t < last[inside])]
                states.append((out, np.full(len(out), t + 1), low[out], high[out]))  # one less
            go = np.flatnonzero((t < last) & (t < lengths))
            code = self.codes[starts[go] + t]
            low[go], high[go] = self.step(code, low[go]), self.step(code, high[go])
        q, at, low, high = (np.concatenate(x) for x in zip(*states, strict=True)) if states else (np.zeros(0, np.int64),) * 4
        found_q, found_w = [], []
        while len(q):
            done = at == lengths[q]
            a, b = self.step(np.zeros(int(done.sum()), np.int64), low[done]), self.step(np.zeros(int(done.sum()), np.int64), high[done])
            hit = b > a
            found_q.append(q[done][hit])
            found_w.append(self.word[self.sorted[a[hit]]])
            q, at, low, high = q[~done], at[~done], low[~done], high[~done]
            code = self.codes[starts[q] + at]
            low, high = self.step(code, low), self.step(code, high)
            there = high > low
            q, at, low, high = q[there], at[there] + 1, low[there], high[there]
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found_q) * len(self.lengths) + np.concatenate(found_w))
        return np.divmod(pairs, max(len(self.lengths), 1))


def _shared(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters two words share at their beginning."""
    out, on, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(on):
        on = on[(k < lengths[a[on]]) & (k < lengths[b[on]])]
        on = on[codes[starts[a[on]] + k] == codes[starts[b[on]] + k]]
        k += 1
        out[on] = k
    return out


def _searched(words: list[str], n: np.ndarray, asks: np.ndarray, parts: np.ndarray, part: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, list[str], np.ndarray]]:
    """For words that have near ones in a part: the word, their number, the most frequent one (of equals the least) and its count."""
    own = sorted(set(words))
    place = dict(zip(own, range(len(own)), strict=True))
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    count = np.zeros(len(own), np.int64)
    count[ids] = n
    points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
    _, codes = np.unique(points, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.cumsum(lengths) - lengths
    for from_right in (False, True):
        here = (2 * part < parts) == from_right  # the longer whole side is read first
        known = np.unique(ids[here])
        if not len(known):
            continue
        step = -1 if from_right else 1
        own_at = np.repeat(starts[known], lengths[known])
        nth = np.arange(len(own_at)) - np.repeat(np.cumsum(lengths[known]) - lengths[known], lengths[known])
        flat = codes[own_at + (nth if step > 0 else np.repeat(lengths[known], lengths[known]) - 1 - nth)]
        index = _Index(flat, np.cumsum(lengths[known]) - lengths[known], lengths[known])
        asking = np.flatnonzero(here & asks)
        for start in range(0, len(asking), _TOGETHER):
            rows = asking[start : start + _TOGETHER]
            size = lengths[ids[rows]]
            low, high = part[rows] * size // parts[rows], (part[rows] + 1) * size // parts[rows]
            first, last = (size - high, size - low) if from_right else (low, high)
            q, w = index.one_off(np.searchsorted(known, ids[rows]), first, last)
            w = known[w]
            at = _shared(codes, starts, lengths, ids[rows][q], w)
            counts_here = (at >= low[q]) & ((at < high[q]) | (part[rows][q] == parts[rows][q] - 1))
            q, w = q[counts_here], w[counts_here]
            if not len(q):
                continue
            order = np.lexsort((w, -count[w], q))
            q, w = q[order], w[order]
            firsts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            yield [own[i] for i in ids[rows][q[firsts]].tolist()], np.diff(np.concatenate((firsts, [len(q)]))), [own[i] for i in w[firsts].tolist()], count[w[firsts]]


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word, n, n_near, form, form_n`` of ``word, n``: how many words are one edit away, and the most frequent of these (of equals the least)."""
    dealt = _split(words, most)
    tasks = max(1, math.ceil(6 * words.count() / _PER_TASK))

    def run(batches):
        held = [[], [], [], [], []]
        for batch in batches:
            for column, name in zip(held, ("word", "n", "asks", "parts", "part"), strict=True):
                column.append(batch.column(name).to_pylist() if name == "word" else batch.column(name).to_numpy(zero_copy_only=False))
        if held[0]:
            told = [w for part in held[0] for w in part]
            n, asks, parts, part = (np.concatenate(c) for c in held[1:])
            for word, n_near, form, form_n in _searched(told, n, asks.astype(np.bool_), parts.astype(np.int64), part.astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(form, pa.string()), pa.array(form_n, pa.int64())], names=["word", "n_near", "form", "form_n"])

    found = dealt.repartition(tasks, "key").mapInArrow(run, "word string, n_near long, form string, form_n long")
    nothing = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    both = nothing.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    told = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return told.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def variants(words: DataFrame, ratio: int = 10, most: int = MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` (each word once).

    A word's form is its most frequent near word if that is ``ratio`` times as
    frequent (over 1); its root is where forms lead.  Chains grow in frequency, so
    the number of joins, which double the way, follows from the largest count.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = checkpointed(words.select("word", "n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    told = checkpointed(near_words(words, most).select("word", F.when(enough, F.col("form")).alias("form"), "n", "n_near", F.when(enough, F.col("form_n")).alias("form_n")))
    low, high = told.agg(F.min("n"), F.max("n")).first()
    leads = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(high / low, 1), ratio)))) + 1 if low else 0):
        onward = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        leads = checkpointed(leads.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return told.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
