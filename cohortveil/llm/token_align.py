"""Alignment of two tokenizers over one text: exact-text deduplication, one alignment a distinct text.

Texts are grouped by the whole text, so copies (however many) are tokenised
once.  Byte offsets where a token of A and one of B both end cut the two token
rows into groups; a token of A and one of B are linked if they share a group.
How many documents hold an id pair linked is a sum of the texts' multiplicities.
Pairs of high count (at most ``head``, a bound on what is sent to the tasks) are
looked up in sorted arrays; the others, whose counts are low, so that no key is
a hot one, are joined by a shuffle.  Where the line falls changes no result.

A null or empty text, and one whose tokens don't spell it exactly, has no
tokens.  Repeated rows are documents of their own; other columns aren't read.
A text is worked on by one task.  In a group, ids of equal value are counted
together, so a long group without a common end costs its distinct id pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, texts

#: Fixed value: the pattern that splits text before the merges of a byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs of ids that are sent to the tasks at most, 17 bytes each.
HEAD = 1 << 20
#: Bytes of texts that a task aligns together, and the products of a group's sizes up to which its links are listed one by one.
_TOGETHER, _LISTED = 1 << 21, 4096
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class _ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file; ``spelled[id]`` are a token's bytes."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        told, byte = json.loads(data), _byte_of_char()
        vocab, special = told["model"]["vocab"], {t["content"] for t in told.get("added_tokens", ())}
        if any(c not in byte for t in vocab if t not in special for c in t):
            raise ValueError("the vocabulary isn't byte-level")
        self.spelled = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told.get("added_tokens", ()))]))
        for t, i in vocab.items():
            self.spelled[i] = t.encode() if t in special else bytes(map(byte.__getitem__, t))
        self.whole = Tokenizer.from_str(data.decode())
        self.whole.encode_special_tokens = True
        self.ranked = None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        if [vocab.get(a + b) for a, b in merges] == [*range(256, 256 + len(merges))] and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not told.get("normalizer"):
            import tiktoken  # ids in the order of the merges: the same tokens by ranks, and faster

            self.ranked = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.spelled) if i < 256 + len(merges)}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked is None or len(text) > 4000 and _LONG_RUN.search(text):  # work on ranks grows with the square of a run
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


class _Pieces:
    """A ``sentencepiece`` model."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        size = self.model.vocab_size()
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.model.id_to_piece(list(range(size))))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(kind: type, data: bytes):
    """A worker loads a vocabulary once."""
    found = kind(data)
    found.widths = np.array([len(x) for x in found.spelled], np.int64)
    return found


@lru_cache(maxsize=2)
def _marks(n_a: int, n_b: int) -> list[str]:
    """How an id is written: of A inside and at the end of its side of a group, then the same of B."""
    return [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]


def _linked(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair and number of links, by group; in large groups equal ids count together."""
    links = n_a * n_b
    first_b = np.cumsum(n_b) - n_b
    small = links[group_a] <= _LISTED
    at = np.flatnonzero(small)
    times = n_b[group_a[at]]
    of = np.repeat(at, times)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    groups = [group_a[of]]
    pairs = [ids_a[of] * size_b + ids_b[first_b[groups[0]] + nth]]
    counts = [np.ones(len(of), np.int64)]
    first_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(links > _LISTED).tolist():
        a, ca = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        b, cb = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs.append((a[:, None] * size_b + b).ravel())
        counts.append((ca[:, None] * cb).ravel())
        groups.append(np.full(len(a) * len(b), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(counts)


def _align(rows: list[str], a: _ByteLevel, b: _Pieces) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """For each text: tokens of A and of B, groups, links, the groups as text, its id pairs and their links."""
    tokens: list[tuple[list, list]] = []
    for text in rows:
        wanted = b" " + text.encode()
        ids = (a.encode(" " + text), b.encode(text)) if text else ([], [])
        spelled = all(b"".join(map(v.spelled.__getitem__, x)) == wanted for v, x in zip((a, b), ids, strict=True)) if text else False
        tokens.append(ids if spelled else ([], []))
    size_a, size_b = len(a.spelled), len(b.spelled)
    ids_a, ids_b = (np.array([i for t in tokens for i in t[side]], np.int64) for side in (0, 1))
    to_a, to_b = (np.cumsum([len(t[side]) for t in tokens]) for side in (0, 1))
    # texts one after the other: both sides end together where a text ends, so offsets run on
    ends_a, ends_b = np.cumsum(a.widths[ids_a]), np.cumsum(b.widths[ids_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    lasts = np.concatenate(([0], np.cumsum(n_a)))
    groups_to = np.searchsorted(lasts, to_a)  # groups before a text's end: a text's tokens fill whole groups

    after_a, after_b = np.cumsum(n_a), np.cumsum(n_b)
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    is_last = np.zeros(len(ids_a), np.int64)
    is_last[after_a - 1] = size_a
    codes[np.arange(len(ids_a)) + (after_b - n_b)[group_a]] = ids_a + is_last
    is_last = np.zeros(len(ids_b), np.int64)
    is_last[after_b - 1] = size_b
    codes[np.arange(len(ids_b)) + after_a[group_b]] = 2 * size_a + ids_b + is_last
    written = list(map(_marks(size_a, size_b).__getitem__, codes.tolist()))

    group, pair, count = _linked(ids_a, ids_b, group_a, group_b, n_a, n_b, size_b)
    row = np.searchsorted(groups_to, group, side="right")
    key = row * (size_a * size_b) + pair
    order = np.argsort(key)
    key, count = key[order], count[order]
    firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), np.bool_), key[1:] != key[:-1])))
    sums = np.add.reduceat(count, firsts) if len(firsts) else count
    key = key[firsts]
    bounds = np.searchsorted(key, np.arange(len(rows) + 1) * (size_a * size_b))
    links = np.concatenate(([0], np.cumsum(n_a * n_b)))
    was_a = was_b = was_g = 0
    for n, (end_a, end_b, end_g) in enumerate(zip(to_a.tolist(), to_b.tolist(), groups_to.tolist(), strict=True)):
        own = slice(bounds[n], bounds[n + 1])
        yield end_a - was_a, end_b - was_b, end_g - was_g, int(links[end_g] - links[was_g]), "".join(written[was_a + was_b : end_a + end_b])[:-1], key[own] - n * size_a * size_b, sums[own]
        was_a, was_b, was_g = end_a, end_b, end_g


def _ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind.to_pandas_dtype()), kind))


def _tokenised(distinct: DataFrame, a_data, b_data, pair_type: str) -> DataFrame:
    kind = pa.int32() if pair_type == "int" else pa.int64()

    def run(batches):
        a, b = _loaded(_ByteLevel, a_data.value), _loaded(_Pieces, b_data.value)
        for batch in batches:
            rows, held, start = batch.column("text").to_pylist(), 0, 0
            for n, text in enumerate(rows, 1):
                held += len(text)
                if held >= _TOGETHER or n == len(rows):
                    n_a, n_b, n_groups, n_links, groups, pairs, links = zip(*_align(rows[start:n], a, b), strict=True)
                    arrays = [batch.column(c).slice(start, n - start) for c in ("digest", "times")] + [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(groups, pa.string()), _ragged(list(pairs), kind), _ragged(list(links), pa.int64())], names=["digest", "times", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])
                    held, start = 0, n

    return distinct.mapInArrow(run, f"digest binary, times long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{pair_type}>, links array<long>")


def _looked_up(found: DataFrame, told) -> DataFrame:
    """``found`` with n_best and count_sum over the pairs that were sent."""

    def run(batches):
        known, counts, best = told.value
        for batch in batches:
            pairs, links = (batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("pairs", "links"))
            pair, n = pairs.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            here = known[at] == pair if len(known) else np.zeros(len(pair), np.bool_)
            sums = []
            ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))))
            for value in ((best[at] & here) * n, counts[at] * here * n) if len(known) else (np.zeros(len(pair), np.int64),) * 2:
                upto = np.concatenate(([0], np.cumsum(value)))
                sums.append(upto[ends[1:]] - upto[ends[:-1]])
            keep = [batch.column(c) for c in ("digest", "n_a", "n_b", "n_groups", "n_links", "groups")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(s, pa.int64()) for s in sums)], names=["digest", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    return found.mapInArrow(run, f"digest binary, n_a long, n_b long, n_groups long, n_links long, groups {found.schema['groups'].dataType.simpleString()}, n_best long, count_sum long")


def _others(found: DataFrame, told, pair_type: str) -> DataFrame:
    """``digest, pair, n`` of the pairs that weren't sent."""

    def run(batches):
        known = told.value[0]
        for batch in batches:
            lists = batch.column("pairs")
            pair, n = lists.flatten().to_numpy(zero_copy_only=False), batch.column("links").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            out = np.flatnonzero(known[at] != pair) if len(known) else np.arange(len(pair))
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(row[out])), pa.array(pair[out], lists.type.value_type), pa.array(n[out], pa.int64())], names=["digest", "pair", "n"])

    return found.select("digest", "pairs", "links").mapInArrow(run, f"digest binary, pair {pair_type}, n long")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[Column], Column] = lambda text: text, head: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one row for each row of ``docs``.

    ``a_file`` is a byte-level BPE of the library tokenizers, ``b_file`` a model
    of sentencepiece; the driver reads both and sends them.  ``groups`` is the
    alignment as text (``a1,a2|b1;a3|b2,b3``, ids in decimal), or what the
    parameter ``groups`` makes of it before it is written.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        a_data, b_data = spark.sparkContext.broadcast(a.read()), spark.sparkContext.broadcast(b.read())
    size_a, size_b = len(_loaded(_ByteLevel, a_data.value).spelled), len(_loaded(_Pieces, b_data.value).spelled)
    pair_type = "int" if size_a * size_b < 1 << 31 else "long"

    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    distinct = distinct.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "times")
    found = checkpointed(_tokenised(distinct, a_data, b_data, pair_type).withColumn("groups", groups(F.col("groups"))))
    pair_counts = found.select("times", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("times").alias("count"))
    counts = pair_counts.withColumn("a", F.floor(F.col("pair") / size_b).cast("int"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for an id of A at most
    counts = checkpointed(counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))

    level = F.floor(F.log2(F.col("count").cast("double"))).cast("int")
    sizes, least = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True), 0  # a row for a power of two
    total = 0
    for at, n in sizes:
        total += n
        if total > head:
            least = at + 1
            break
    sent = counts.where(level >= least).toArrow()
    order = np.argsort(sent.column("pair").to_numpy())
    known = [sent.column(c).to_numpy()[order] for c in ("pair", "count", "best")]
    told = spark.sparkContext.broadcast(known)
    measured = _looked_up(found, told)
    if least:
        rest = _others(found, told, pair_type).join(counts.where(level < least), "pair")
        rest = rest.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
        zero = F.lit(0).cast("long")
        measured = measured.join(rest, "digest", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)}).drop("more_best", "more_sum")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    nothing = groups(F.lit("")).cast(measured.schema["groups"].dataType)
    joined = rows.select("doc_id", "digest").join(measured, "digest", "left")
    return joined.select("doc_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names), F.coalesce("groups", nothing).alias("groups"))
