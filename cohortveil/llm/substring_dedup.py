"""Substring dedup: repeated word sequences by prefix-partitioned suffix trees.

A suffix is a word position with ``window`` words after it.  Suffixes are dealt
out by prefixes of variable length: from the suffix's start to the end of its
anchor, the gram of ``gram`` words with the least hash among those of its
window.  Equal windows have equal anchors at equal places, so equal windows meet
in one group.

1. Each document's anchors are counted; suffixes whose anchor occurs once in the
   whole corpus can't repeat and end here.
2. The other anchors' segments (the words that their suffixes reach) go to
   groups by anchor.  A group that would hold more than ``most_segments`` is dealt
   by longer prefixes, as long as the window: such a group is one tree node, and
   its count is all that is needed.  Suffixes that meet in one batch already are
   not sent to meet again, so no group grows with a passage's copies.
3. In a group the subtree is built from the root down, a few words an edge;
   branches with one suffix are cut at once.  The nodes left at a depth of
   ``window`` words are repeats; the suffixes below them start repeated windows.
4. Words that such windows cover are removed; touching windows make the maximal
   repeated spans.

Windows are judged on the input.  A null or empty text has no words.  Repeated
rows repeat each other's windows.  ``key`` is a hash of the id and text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bounded_batches, checkpointed, fresh
from .words import covered, gram_hashes, mix, utf8_views, word_hashes, word_spans

#: Segments of an anchor beyond which its suffixes are dealt by the whole window.
MOST_SEGMENTS = 50_000
#: Up to so many such anchors are sent to the tasks; more are joined by a shuffle.
BROADCAST_ANCHORS = 1_000_000
_EDGE = 7


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, place, first and last suffix of each anchor of a text's word hashes."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.view(np.uint64), none, none, none
    least = gram_hashes(words, gram)
    at, have, width = np.arange(len(least)), 1, window - gram + 1
    value = least
    while have < width:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.where(left, value[:-step], value[step:])
        have += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return least[at[first]], at[first], first, last


def _longs(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def _anchor_rows(window: int, gram: int):
    """``anchor, key, place, weight``: 0 for anchors met again in the same batch, 1 for others, 2 for one row that tells of the former."""

    def emit(batches):
        for batch in batches:
            hashes, places, keys = [], [], []
            for key, view in zip(batch.column("key").to_pylist(), utf8_views(batch.column("text")), strict=True):
                found, place, _, _ = anchors(word_hashes(view, *word_spans(view)), window, gram)
                hashes.append(found)
                places.append(place)
                keys.append(np.full(len(found), key, np.int64))
            anchor, key, place = _longs(hashes), _longs(keys), _longs(places).astype(np.int32)
            value, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            weight = (counts[inverse] == 1).astype(np.int8)
            again = value[counts > 1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((anchor, again))), pa.array(np.concatenate((key, np.zeros(len(again), np.int64)))),
                pa.array(np.concatenate((place, np.full(len(again), -1, np.int32)))), pa.array(np.concatenate((weight, np.full(len(again), 2, np.int8)))),
            ], names=["anchor", "key", "place", "weight"])

    return emit


def _segment_rows(window: int, gram: int, text_col: str, own_key: str, own_anchors: str):
    """``part, key, start, offset, n, segment, weight``: a segment for each listed anchor; of a heavy one, a row for each suffix.

    Heavy suffixes have no segment; their part is the whole window's hash, and
    their weight is 1 if they are alone in the batch, 0 if they met there (then
    ``n`` is a mask of such suffixes and the part is their own), 2 for the one
    row that tells other batches of those that met.
    """

    def emit(batches):
        for batch in batches:
            parts, keys, starts, offsets, counts, segments = [], [], [], [], [], []
            heavy: list[tuple[np.ndarray, ...]] = []
            for key, view, listed in zip(batch.column(own_key).to_pylist(), utf8_views(batch.column(batch.schema.get_field_index(text_col))), batch.column(own_anchors).to_pylist(), strict=True):
                begin, end = word_spans(view)
                words = word_hashes(view, begin, end)
                found, place, first, last = anchors(words, window, gram)
                chosen = np.flatnonzero(np.isin(place, np.array([a["place"] for a in listed if not a["heavy"]], dtype=np.int64)))
                parts += found[chosen].view(np.int64).tolist()
                keys += [key] * len(chosen)
                starts += first[chosen].tolist()
                offsets += (place - first)[chosen].tolist()
                counts += (last - first + 1)[chosen].tolist()
                data = view.tobytes()
                segments += [data[a:b] + b" " for a, b in zip(begin[first[chosen]].tolist(), end[last[chosen] + window - 1].tolist(), strict=True)]
                crowded = np.flatnonzero(np.isin(place, np.array([a["place"] for a in listed if a["heavy"]], dtype=np.int64)))
                if len(crowded):
                    whole = gram_hashes(words, window, 6).view(np.int64)
                    n = last[crowded] - first[crowded] + 1
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.repeat(first[crowded], n)
                    heavy.append((whole[own + nth], np.full(len(own), key, np.int64), own, nth))
            weights = [1] * len(parts)
            if heavy:
                whole, key, first, nth = (np.concatenate([h[i] for h in heavy]) for i in range(4))
                value, inverse, times = np.unique(whole, return_inverse=True, return_counts=True)
                alone = times[inverse] == 1
                rows, row = np.unique(np.stack((key[~alone], first[~alone])), axis=1, return_inverse=True)
                met = np.zeros(rows.shape[1], np.int64)
                np.bitwise_or.at(met, row.ravel(), np.int64(1) << nth[~alone])  # rows that repeat whole tell the same bits
                told = value[times > 1]
                for part_, key_, start_, n_, weight in (
                    (whole[alone], key[alone], (first + nth)[alone], np.ones(alone.sum(), np.int64), 1),
                    (mix(rows[0].view(np.uint64) + rows[1].view(np.uint64)).view(np.int64), rows[0], rows[1], met, 0),
                    (told, np.zeros(len(told), np.int64), np.zeros(len(told), np.int64), np.zeros(len(told), np.int64), 2),
                ):
                    parts += part_.tolist()
                    keys += key_.tolist()
                    starts += start_.tolist()
                    offsets += [0] * len(part_)
                    counts += n_.tolist()
                    segments += [None] * len(part_)
                    weights += [weight] * len(part_)
            columns = (pa.array(parts, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(offsets, pa.int32()), pa.array(counts, pa.int64()), pa.array(segments, pa.binary()), pa.array(weights, pa.int8()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["part", "key", "start", "offset", "n", "segment", "weight"])

    return emit


def subtree_repeats(part: np.ndarray, offset: np.ndarray, n: np.ndarray, text: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """A bit mask for each segment: which of its ``n`` suffixes have a node of depth ``window`` with another suffix below.

    ``text`` holds the segments, each ended by white space, ``bounds`` their ends.
    """
    begin, end = word_spans(text)
    words = word_hashes(text, begin, end)
    first_word = np.searchsorted(begin, bounds[:-1])
    row = np.repeat(np.arange(len(part)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first_word[row] + nth
    # the root: suffixes of one anchor that stand equally far before it
    node = mix(part.view(np.uint64)[row] + mix((offset[row] - nth).astype(np.uint64)))
    edges = gram_hashes(words, _EDGE, 8)
    alive = np.arange(len(row))
    for depth in [*range(0, window - _EDGE, _EDGE), window - _EDGE]:
        node = mix(node ^ edges[at[alive] + depth])
        _, inverse, counts = np.unique(node, return_inverse=True, return_counts=True)
        branching = counts[inverse] > 1
        alive, node = alive[branching], node[branching]
    return np.bincount(row[alive], weights=np.exp2(nth[alive]), minlength=len(part)).astype(np.int64)


def _trees(window: int):
    """``key, start, mask`` of segments with repeats; the rows of a part come together."""

    def grow(table: pa.Table) -> pa.RecordBatch:
        crowded = table["segment"].is_null().to_numpy()
        mask = np.zeros(table.num_rows, np.int64)
        if crowded.any():
            part, weight, n = (table[c].to_numpy()[crowded] for c in ("part", "weight", "n"))
            _, inverse = np.unique(part, return_inverse=True)
            twice = np.bincount(inverse, weight)[inverse] > 1
            mask[crowded] = np.where(weight == 0, n, np.where((weight == 1) & twice, 1, 0))
        if not crowded.all():
            light = table.filter(pa.array(~crowded)).combine_chunks()
            column = light["segment"].chunk(0)
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            text = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            mask[~crowded] = subtree_repeats(light["part"].to_numpy(), light["offset"].to_numpy(), light["n"].to_numpy(), text, bounds - bounds[0], window)
        kept = mask > 0
        return pa.RecordBatch.from_arrays([pa.array(table["key"].to_numpy()[kept]), pa.array(table["start"].to_numpy()[kept]), pa.array(mask[kept])], names=["key", "start", "mask"])

    def emit(batches):
        held: list[pa.Table] = []  # rows of one part
        for batch in batches:
            table = pa.Table.from_batches([batch])
            part = table["part"].to_numpy()
            if not len(part):
                continue
            begin = int(np.searchsorted(part, part[-1]))
            if held and (begin or held[0]["part"][0].as_py() != part[0]):
                yield grow(pa.concat_tables([*held, table.slice(0, begin)]))
                held = []
            elif begin:
                yield grow(table.slice(0, begin))
            held.append(table.slice(begin))
        if held:
            yield grow(pa.concat_tables(held))

    return emit


def _removed(window: int, text_col: str, own_key: str, own_found: str):
    def emit(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for view, found in zip(utf8_views(batch.column(batch.schema.get_field_index(text_col))), batch.column(own_found).to_pylist(), strict=True):
                words = view.tobytes().split()
                n_words.append(len(words))
                if not found:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                starts = np.unique([f["start"] + i for f in found for i in range(f["mask"].bit_length()) if f["mask"] >> i & 1])
                out = covered(starts, window, len(words))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))).tolist()
                n_removed.append(int(out.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)])
                kept.append(b" ".join(compress(words, (~out).tolist())))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (own_key, own_found)}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return emit


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 12, most_segments: int = MOST_SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns n_words, n_removed, kept_text (kept words joined by a space) and removed (spans of words, from and to).

    ``gram`` is at least 7 and at most the window, which is at most ``gram + 40``.
    """
    if not _EDGE <= gram <= window <= gram + 40:
        raise ValueError("gram and window don't fit together")
    bounded_batches(docs.sparkSession)
    own_key, own_anchors, own_found = fresh(docs.columns, "_key", "_anchors", "_found")
    rows = docs.drop("n_words", "n_removed", "kept_text", "removed").withColumn(own_key, F.xxhash64(id_col, text_col))
    listed = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(_anchor_rows(window, gram), "anchor long, key long, place int, weight byte")
    by = F.when(F.col("weight") == 0, F.xxhash64("key", "place")).otherwise(F.col("anchor"))
    weighed = listed.withColumn("part", by).withColumn("total", F.sum("weight").over(Window.partitionBy("part")))
    repeated = checkpointed(weighed.where("weight = 0 or weight = 1 and total > 1").select("anchor", "key", "place"))
    crowded = repeated.groupBy("anchor").count().where(F.col("count") > most_segments).select("anchor", F.lit(True).alias("heavy"))
    if crowded.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS:
        crowded = F.broadcast(crowded)
    flagged = repeated.join(crowded, "anchor", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    of_doc = flagged.groupBy(F.col("key").alias(own_key)).agg(F.collect_set(F.struct("place", "heavy")).alias(own_anchors))
    chosen = rows.join(of_doc, own_key)  # all columns, so that this and the last join read one shuffle of the rows
    segments = chosen.mapInArrow(_segment_rows(window, gram, text_col, own_key, own_anchors), "part long, key long, start int, offset int, n long, segment binary, weight byte")
    found = segments.repartition("part").sortWithinPartitions("part").mapInArrow(_trees(window), "key long, start int, mask long")
    of_key = found.groupBy(F.col("key").alias(own_key)).agg(F.collect_set(F.struct("start", "mask")).alias(own_found))
    fields = [f for f in rows.schema.fields if f.name != own_key]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", spans)]
    return rows.join(of_key, own_key, "left").mapInArrow(_removed(window, text_col, own_key, own_found), T.StructType(fields + more))
