"""Toxicity by a weighted lexicon.

Texts are folded (small letters, look-alike letters, digits that stand for
letters, punctuation as space).  The lexicon holds word beginnings and whole
words whose share among documents labelled toxic is far above that among
others, each with its log odds as weight; Aho-Corasick finds them at word
starts, and the longest one of a word counts.  A match inside an exception
phrase (word pairs that clean documents hold) doesn't count.  The sum of
weights, alone and by length, goes through a logistic curve.

Lexicon, phrases and curve are fitted on a bounded sample of labelled rows
(``max_toxic`` and ``max_clean`` rows with the least hashes of their ids), and
each holds at most ``max_terms`` terms, those that most documents of the sample
hold; all documents are scored.  A null or empty text has no match and takes the curve's
lowest score.  Without toxic rows, or terms that tell them, the lexicon is empty and all scores are 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, texts
from .words import gram_hashes, utf8_views, word_hashes, word_spans

# Letters that look like a Latin one, and signs that stand for one.
_ALIKE = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l"}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
_WIDE = {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)}
_PUNCTUATION = {chr(b): " " for b in range(128) if not chr(b).isalnum()} | {c: " " for c in " ‘’“”–—…«»¿¡"}
_HIDDEN = {c: None for c in "​‌‍⁠﻿­"}
_FOLD = str.maketrans(_PUNCTUATION | _SIGNS | _ALIKE | _WIDE | _HIDDEN)
_END_SIGNS = str.maketrans({"!": " "})


def fold(text: str) -> str:
    """The folded text between two spaces.  Exclamation marks at a word's end are punctuation."""
    text = text.lower()
    if "!" in text:
        text = " ".join(w.rstrip("!") if w.endswith("!") else w for w in text.split(" "))
    return f" {text.translate(_FOLD)} "


def terms_of(folded: str, shortest: int = 3, longest: int = 8) -> set[str]:
    """What a text offers the lexicon: beginnings of its words, and whole words, each after a space."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))
    return out


def words_of(folded: str) -> Counter:
    """How many distinct words of a text each term stands for; all of them under the empty term."""
    out: Counter = Counter()
    for word in set(folded.split()):
        out.update([f" {word} ", "", *(f" {word[:k]}" for k in range(3, min(8, len(word)) + 1))])
    return out


def automaton(weights: dict[str, float], exceptions: tuple[str, ...] = ()) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        found.add_word(phrase, (len(phrase), 0.0))
    found.make_automaton()
    return found


def matches(folded: str, found: ahocorasick.Automaton) -> Iterator[tuple[int, int, float]]:
    """(start, length, weight) of the longest term of each word, but for those in an exception phrase."""
    best: dict[int, tuple[int, float]] = {}
    excepted: list[tuple[int, int]] = []
    for end, (length, weight) in found.iter(folded):
        start = end - length + 1
        if not weight:
            excepted.append((start, end))
        elif length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    for start, (length, weight) in best.items():
        if not any(a <= start < b for a, b in excepted):
            yield start, length, weight


def figures(text: str, found: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """log(1 + weight), log(1 + weight per hundred words), log(1 + matches)."""
    if not text or found is None:
        return 0.0, 0.0, 0.0
    folded = fold(text)
    weights = [w for _, _, w in matches(folded, found)]
    total = sum(weights)
    return math.log1p(total), math.log1p(100 * total / max(20, folded.count(" ") - 1)), math.log1p(len(weights))


def _counted(sample: DataFrame, terms) -> DataFrame:
    """``term, toxic, docs`` summed over the sample; ``terms`` gives a folded text's (with their numbers, or one each), each task adds its own first."""

    def count(batches):
        toxic, docs = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = terms(fold(text), label)
                docs.update(own)
                if label:
                    toxic.update(own)
        names = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([docs[n] for n in names], pa.int64())], names=["term", "toxic", "docs"])

    return sample.mapInArrow(count, "term string, toxic long, docs long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))


def _sketched(sample: DataFrame) -> DataFrame:
    """``sample`` with the least hash of each text's word triples: most near copies have the same, and count once."""

    def sketch(batches):
        for batch in batches:
            least = []
            for view in utf8_views(batch.column("text")):
                grams = gram_hashes(word_hashes(view, *word_spans(view)), 3)
                least.append(int(grams.min()) - (1 << 63) if len(grams) else len(view))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(least, pa.int64())], names=["text", "toxic", "sketch"])

    return sample.mapInArrow(sketch, "text string, toxic int, sketch long")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps with a ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(x) * 1e-3 * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)) * ridge * len(x) * 1e-3
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_toxic: int = 10_000, max_clean: int = 20_000, min_docs: int = 8, min_odds: float = 3.0, max_terms: int = 20_000) -> tuple[dict[str, float], tuple[str, ...], np.ndarray]:
    """Lexicon, exception phrases and the curve's weights.

    ``labels`` has doc_id and toxic; ``may_learn`` says of doc_id whether its
    label may be used.  A term must stand in ``min_docs`` toxic documents, or in a
    tenth of them (3 at least) where these are few.  What the driver holds is bounded
    by the parameters.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda label, most: usable.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    picked = docs.join(F.broadcast(pick(1, max_toxic).unionByName(pick(0, max_clean))), "doc_id").select("text", "toxic")  # at most max_toxic + max_clean ids
    sample = checkpointed(_sketched(picked).groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))  # the least text of near copies
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n_all:
        return {}, (), np.array([0.0, 0.0, 0.0, -30.0])
    min_docs = min(min_docs, max(3, n_toxic // 10))
    offered = _counted(sample.where("toxic = 1"), lambda folded, _: terms_of(folded)).where(F.col("toxic") >= min_docs).orderBy(F.desc("toxic"), "term").limit(max_terms)
    candidates = sample.sparkSession.sparkContext.broadcast(frozenset(r.term for r in offered.select("term").collect()))
    seen = _counted(sample, lambda folded, _: {t: n for t, n in words_of(folded).items() if not t or t in candidates.value}).toArrow().to_pylist()
    of_toxic, of_all = next(((r["toxic"], r["docs"]) for r in seen if not r["term"]), (0, 0))
    odds = {r["term"]: math.log((r["toxic"] + 0.5) / (of_toxic + 1)) - math.log((r["docs"] - r["toxic"] + 0.5) / (of_all - of_toxic + 1)) for r in seen if r["term"]}
    strong = {t: o for t, o in odds.items() if o >= min_odds}
    # a word's beginning stands for the longer ones that say no more
    lexicon = {t: o for t, o in strong.items() if not any(strong.get(t[:k], 0) >= o - 1e-9 or strong.get(t[:k], 0) >= min_odds + 1.5 for k in range(4, len(t)))}
    if not lexicon:  # no term tells the labels apart
        return {}, (), np.array([0.0, 0.0, 0.0, -30.0])
    found = sample.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(folded: str, label: int) -> set[str]:
        own = phrases.__dict__.setdefault("own", None) or automaton(found.value)
        phrases.own = own
        out = set()
        for start, _, _ in matches(folded, own):
            after = folded[start + 1 :].split(" ", 2)
            before = folded[max(0, start - 40) : start].rsplit(" ", 1)[-1]
            if len(after) > 1 and after[1]:
                out.add(f" {after[0]} {after[1]} ")
            if before:
                out.add(f" {before} {after[0]} ")
        return out

    pairs = _counted(sample, phrases).where((F.col("docs") - F.col("toxic") >= min_docs) & (F.col("docs") > 10 * F.col("toxic"))).orderBy(F.desc("docs"), "term").limit(max_terms)
    exceptions = tuple(sorted(r.term for r in pairs.select("term").collect()))
    shared = sample.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    def measure(batches):
        own = automaton(*shared.value)
        for batch in batches:
            x = [figures(t, own) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(3)), batch.column("toxic").cast(pa.int32())], names=["a", "b", "c", "toxic"])

    got = sample.mapInArrow(measure, "a double, b double, c double, toxic int").toArrow()
    x, y = np.column_stack([got[n].to_numpy() for n in "abc"]), got["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    totals = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    weight = np.where(y == 1, totals.get(1, 1) / max(1, y.sum()), totals.get(0, 1) / max(1, (1 - y).sum()))
    return lexicon, exceptions, _logistic(x[order], y[order], (weight / weight.mean())[order])


def score(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, score (0 to 1) and n_matches for each row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    lexicon, exceptions, curve = fit(rows, labels, may_learn, **how)
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, exceptions, curve))

    def judge(batches):
        terms, phrases, w = shared.value
        own = automaton(terms, phrases) if terms else None
        for batch in batches:
            x = np.array([figures(t, own) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
            n = np.rint(np.expm1(x[:, 2])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(n)], names=["doc_id", "score", "n_matches"])

    return rows.mapInArrow(judge, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_matches long")
