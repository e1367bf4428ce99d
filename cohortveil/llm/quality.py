"""Quality rules: base checks and a hashed n-gram log-likelihood ratio.

Words give hashed grams: words (in small letters) and pairs of them in one half
of the buckets, and the words' shapes, alone, in pairs and in threes, in the
other, so that a text of words never met is judged by what they look like.  Their
counts over a trusted target (documents labelled good) and over the raw corpus
make two multinomials over the buckets.  A document's mean log ratio per gram,
target against raw, is compared with a fixed threshold.

The raw counts are sums over all documents, the target's over a bounded sample of
labelled ones; both are arrays of fixed size, and those are what the tasks are
sent.  A null or empty text has no words; it fails the base
check.  Without labelled rows the ratio is 0 for all and only the base check
decides.  Repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh, texts
from .words import LOWER, gram_hashes, mix, utf8_views, word_hashes, word_spans

BUCKETS = 1 << 15
_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_CODE_POINT = np.array([not 0x80 <= b <= 0xBF for b in range(256)])
#: Classes of bytes for word shapes: small, capital, digit, other ASCII by itself, not ASCII as small.
_SHAPE = np.array([1 if 97 <= b <= 122 or b >= 0x80 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 8 + b for b in range(256)], dtype=np.uint64)


def _shape_hashes(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's first and last byte class, last-but-one byte class and short length."""
    kinds = _SHAPE[view]
    last, before = kinds[ends - 1], kinds[np.maximum(ends - 2, starts)]
    length = np.minimum(ends - starts, 24).astype(np.uint64) // np.uint64(4)
    return mix(kinds[starts] + (last << np.uint64(8)) + (before << np.uint64(16)) + (length << np.uint64(24)))


def gram_buckets(view: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each gram: of words and pairs of words; of shapes, alone and in pairs and threes, and of a word said again at once."""
    if not len(starts):
        return np.zeros(0, np.int64)
    small = word_hashes(LOWER[view], starts, ends)
    shapes = _shape_hashes(view, starts, ends)
    again = mix(np.full(int((hashes[1:] == hashes[:-1]).sum()), 77, np.uint64))
    words = np.concatenate((mix(small), gram_hashes(small, 2, 2)))
    kinds = np.concatenate((shapes, gram_hashes(shapes, 2, 3), gram_hashes(shapes, 3, 4), again))
    half = np.uint64(buckets // 2)
    return np.concatenate((words % half, kinds % half + half)).astype(np.int64)


def base_figures(view: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int, int]:
    """Word starts, ends and hashes; code points in words, symbols, repeated lines, words in repeated windows of five."""
    starts, ends = word_spans(view)
    hashes = word_hashes(view, starts, ends)
    points = np.concatenate(([0], np.cumsum(_CODE_POINT[view])))
    word_chars = int((points[ends] - points[starts]).sum()) if len(starts) else 0
    symbols = int(_SYMBOL[view].sum())
    data = view.tobytes()
    seen, dup_lines = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.split():
            seen.add(line)
    grams = gram_hashes(hashes, 5, 5)
    n_repeat = 0
    if len(grams):
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[inverse] > 1)
        if len(twice):
            edge = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + 5, -1)
            n_repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return starts, ends, hashes, word_chars, symbols, dup_lines, n_repeat


def gram_counts(docs: DataFrame, trusted_col: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all of ``docs`` and over its trusted rows.  Tasks send sums in pieces of fixed size."""

    def count(batches):
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for view, trusted in zip(utf8_views(batch.column("text")), batch.column(trusted_col).to_pylist(), strict=True):
                starts, ends = word_spans(view)
                got = np.bincount(gram_buckets(view, starts, ends, word_hashes(view, starts, ends), buckets), minlength=buckets)
                sums[0] += got
                if trusted:
                    sums[1] += got
        flat = np.arange(buckets)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"])

    sums = docs.select("text", trusted_col).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = sums.toArrow()
    out = np.zeros((2, buckets))
    at = got["bucket"].to_numpy()
    out[0, at], out[1, at] = got["raw"].to_numpy(), got["target"].to_numpy()
    return out[0], out[1]


def _figures_schema() -> list[T.StructField]:
    kinds = (*[T.LongType()] * 5, T.BooleanType(), T.DoubleType(), T.BooleanType())
    return [T.StructField(n, k) for n, k in zip(_FIGURES, kinds, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.2, min_words: int = 10, max_repeat_percent: int = 20, smoothing: float = 1.0, max_trusted: int = 50_000, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Columns ``carry`` of each row of ``docs`` (the id, if not given), then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``labels`` has doc_id and quality; rows of quality 1 are the trusted target,
    at most ``max_trusted`` of them, those with the least hashes of their ids.
    """
    carry = [id_col] if carry is None else [c for c in carry if c not in _FIGURES]
    rows = texts(docs, id_col, text_col)
    usable = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    raw, target = gram_counts(rows.join(F.broadcast(good), "doc_id", "left"), "trusted", buckets)  # at most max_trusted ids
    ratio = np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets)) if target.sum() else np.zeros(buckets)
    shared = rows.sparkSession.sparkContext.broadcast(ratio)
    (own_text,) = fresh(carry, "_text")
    whole = docs.select(*carry, F.col(text_col).alias(own_text))
    schema = T.StructType([whole.schema[c] for c in carry] + _figures_schema())

    def score(batches):
        table = shared.value
        for batch in batches:
            out = []
            for view in utf8_views(batch.columns[-1]):
                starts, ends, hashes, chars, symbols, lines, repeat = base_figures(view)
                grams = gram_buckets(view, starts, ends, hashes, buckets)
                llr = float(table[grams].mean()) if len(grams) else 0.0
                failed = len(starts) < min_words or 100 * repeat > max_repeat_percent * len(starts)
                out.append((len(starts), chars, symbols, lines, repeat, failed, llr, not failed and llr >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*carry, *_FIGURES])

    return whole.mapInArrow(score, schema)
