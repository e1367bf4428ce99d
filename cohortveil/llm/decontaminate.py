"""Benchmark decontamination by winnowing.

Both sides are cut into grams of ``gram`` words; of each ``window - gram + 1``
consecutive grams the one with the least hash is kept as a fingerprint.  A span
of ``window`` words in both has the same least gram on both sides, so joining
the fingerprints misses no shared span.  Around each fingerprint met, the windows
of ``window`` words that hold it are then compared, which extends the hit to
the whole shared span.  Items of fewer words than a window are one window of
their own length.

Where the benchmark's windows are few (a checked limit) both joins run against
sorted arrays sent to the tasks, in one pass over the texts; beyond it, they
are shuffled joins.  Both ways give the same rows.

A null or empty text has no words and no hits.  Repeated rows, also ones with
the same id, are each judged on their own; repeated or null item ids count
once by their text form (null: left out).  Without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bounded_batches
from .words import LOWER, PLAIN, covered, gram_hashes, utf8_views, winnow, word_hashes, word_spans

#: Benchmarks of up to so many windows are sent to the tasks (16 bytes each).
BROADCAST_WINDOWS = 2_000_000

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))]
_FIGURES = tuple(f.name for f in _FIELDS)


def _words(view: np.ndarray) -> np.ndarray:
    data = LOWER[view]
    return word_hashes(data, *word_spans(data, PLAIN))


def _item_windows(items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``hash, width, item`` of each item's windows, and ``hash`` of its fingerprints."""

    def windows(batches):
        for batch in batches:
            names, hashes, widths = [], [], []
            for name, view in zip(batch.column("item").to_pylist(), utf8_views(batch.column("text")), strict=True):
                words = _words(view)
                width = min(window, len(words))
                if width and name is not None:
                    found = np.unique(gram_hashes(words, width, 2))
                    names += [name] * len(found)
                    widths += [width] * len(found)
                    hashes.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(widths, pa.int32()), pa.array(names, pa.string())], names=["hash", "width", "item"])

    def prints(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for name, view in zip(batch.column("item").to_pylist(), utf8_views(batch.column("text")), strict=True):
                words = _words(view)
                if len(words) >= window and name is not None:
                    grams = gram_hashes(words, gram, 1)
                    found.append(grams[winnow(grams, window - gram + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["hash"])

    return items.mapInArrow(windows, "hash long, width int, item string").distinct(), items.mapInArrow(prints, "hash long").distinct()


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), np.bool_)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _met(words: np.ndarray, prints: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a fingerprint which the benchmark has too."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    grams = gram_hashes(words, gram, 1)
    own = winnow(grams, window - gram + 1)
    hits = own[_among(grams[own], prints)]
    starts = (hits[:, None] - np.arange(window - gram + 1)).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= len(words) - window)])


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


def _result(batch: pa.RecordBatch, rows: list[tuple[int, int, list, list]]) -> pa.RecordBatch:
    n, hit, items, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
    carried = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("_key", "_text", "_starts", "_items")}
    return pa.RecordBatch.from_arrays([*carried.values(), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*carried, *_FIGURES])


def _judged(words: np.ndarray, at: list[tuple[np.ndarray, int]]) -> np.ndarray:
    hit = np.zeros(len(words), np.bool_)
    for starts, width in at:
        if len(starts):
            hit |= covered(starts, width, len(words))
    return hit


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, carry: Sequence[str] | None = None) -> DataFrame:
    """Columns ``carry`` of each row of ``docs`` (the id, if not given), then n_words, n_hit, item_ids (sorted text forms), spans (of hit words, from and to)."""
    bounded_batches(docs.sparkSession)
    carry = [id_col] if carry is None else [c for c in carry if c not in _FIGURES]
    rows = docs.select(F.struct(*carry).alias("_row"), F.xxhash64(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    windows, prints = _item_windows(items, window, gram)
    schema = T.StructType([rows.schema["_row"]] + _FIELDS)
    few = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    found = (_by_broadcast if few else _by_shuffle)(rows, windows, prints, window, gram, schema)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in carry), *_FIGURES)


def _by_broadcast(rows: DataFrame, windows: DataFrame, prints: DataFrame, window: int, gram: int, schema: T.StructType) -> DataFrame:
    context = rows.sparkSession.sparkContext
    listed = windows.toArrow()
    hashes = listed["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    widths = listed["width"].to_numpy()
    shared = context.broadcast((np.sort(prints.toArrow()["hash"].to_numpy().view(np.uint64)), hashes[order], listed["item"].take(pa.array(order)).to_pylist(), sorted(set(widths[widths < window].tolist()))))

    def judge(batches):
        known, table, names, short = shared.value
        for batch in batches:
            out = []
            for view in utf8_views(batch.column("_text")):
                words = _words(view)
                at, found = [], set()
                for starts, width in [(_met(words, known, window, gram), window), *((np.arange(max(0, len(words) - w + 1)), w) for w in short)]:
                    if len(starts):
                        grams = gram_hashes(words, width, 2)[starts]
                        same = _among(grams, table)
                        at.append((starts[same], width))
                        for value in np.unique(grams[same]):
                            found.update(names[np.searchsorted(table, value) : np.searchsorted(table, value, "right")])
                hit = _judged(words, at)
                out.append((len(words), int(hit.sum()), sorted(found), _spans(hit)))
            yield _result(batch, out)

    return rows.drop("_key").mapInArrow(judge, schema)


def _by_shuffle(rows: DataFrame, windows: DataFrame, prints: DataFrame, window: int, gram: int, schema: T.StructType) -> DataFrame:
    short = sorted(r.width for r in windows.where(F.col("width") < window).select("width").distinct().collect())  # under ``window`` values

    def own_prints(batches):
        for batch in batches:
            keys, found = [], [np.zeros(0, np.uint64)]
            for key, view in zip(batch.column("_key").to_pylist(), utf8_views(batch.column("_text")), strict=True):
                grams = gram_hashes(_words(view), gram, 1) if len(view) else np.zeros(0, np.uint64)
                own = np.unique(grams[winnow(grams, window - gram + 1)])
                keys += [key] * len(own)
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], names=["_key", "hash"])

    def own_windows(batches):
        for batch in batches:
            keys, hashes, starts, widths = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for key, view, met in zip(batch.column("_key").to_pylist(), utf8_views(batch.column("_text")), batch.column("met").to_pylist(), strict=True):
                words = _words(view)
                known = np.sort(np.array(met or [], dtype=np.int64).view(np.uint64))
                for at, width in [(_met(words, known, window, gram), window), *((np.arange(max(0, len(words) - w + 1)), w) for w in short)]:
                    if len(at):
                        keys += [key] * len(at)
                        widths += [width] * len(at)
                        starts.append(at)
                        hashes.append(gram_hashes(words, width, 2)[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(widths, pa.int32())], names=["_key", "hash", "start", "width"])

    def judge(batches):
        for batch in batches:
            out = []
            for view, starts, items in zip(utf8_views(batch.column("_text")), batch.column("_starts").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                words = _words(view)
                hit = _judged(words, [(np.array([s["start"] for s in starts or [] if s["width"] == w], dtype=np.int64), w) for w in (*short, window)])
                out.append((len(words), int(hit.sum()), sorted(items or []), _spans(hit)))
            yield _result(batch, out)

    met = rows.mapInArrow(own_prints, "_key long, hash long").join(prints, "hash").groupBy("_key").agg(F.collect_set("hash").alias("met"))
    near = rows.join(met, "_key", "left" if short else "inner").select("_key", "_text", "met").distinct()
    shared = near.mapInArrow(own_windows, "_key long, hash long, start int, width int").join(windows, ["hash", "width"])
    hits = shared.groupBy("_key").agg(F.collect_set(F.struct("start", "width")).alias("_starts"), F.collect_set("item").alias("_items"))
    return rows.join(hits, "_key", "left").mapInArrow(judge, schema)
