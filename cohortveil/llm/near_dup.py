"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, grouping.

A document's set is its distinct shingles of ``width`` words.  Documents of
equal sets are one class from the start (by a 64-bit hash of the set), so exact
copies, however many, count once from then on.  A signature's slot holds, over
all elements, the least of (rank of the slot in the element's random permutation
+ a random fraction); ranks are dealt step by step for all elements of a document
together, and dealing stops once no slot can fall further.

Sets that share a band are joined to the band's least set; the components of
these edges hold all candidate pairs.  Inside a component pairs are confirmed on
full sets: small components whole, larger ones by pairs of blocks of bounded
size, each task giving a forest of its links and never the pairs.  Components of
the confirmed links are the groups.

A text of fewer words than a shingle has its whole word sequence as the only
one; a null or empty text has none and is alone.  Repeated rows are members of
the same class.  A null id never is a group's least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import checkpointed, keyed
from .words import LOWER, gram_hashes, mix, utf8_views, word_hashes, word_spans

SLOTS, ROWS = 128, 4
#: Sets that one confirming task holds of a block; a pair of blocks is twice that.
BLOCK = 256
_STEP = np.uint64(56)


def shingles(view: np.ndarray, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    data = LOWER[view]
    words = word_hashes(data, *word_spans(data))
    return np.unique(gram_hashes(words, min(width, len(words)), 9)) if len(words) else words


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash of distinct hashes: a slot's step in the top byte, then the fraction."""
    n = len(elements)
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    rows = np.arange(n)
    for step in range(slots):
        dealt = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (2 * step + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = (step + (dealt >> np.uint64(16)) % np.uint64(slots - step)).astype(np.int64)
        value = (mix(dealt ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(8)) | (np.uint64(step) << _STEP)
        if step == 0:
            slot, first = at, at
        else:
            if order is None:
                order = np.empty((n, slots), np.uint8)
                order[:] = np.arange(slots, dtype=np.uint8)
                order[rows, first], order[:, 0] = 0, first
            slot = order[rows, at].astype(np.int64)
            order[rows, at], order[:, step] = order[:, step], slot
        np.minimum.at(least, slot, value)
        if step + 1 < slots and least.max() < np.uint64(step + 1) << _STEP:
            break
    return least


def bands(signature_: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of ``rows`` slots, its number included."""
    parts = signature_.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        out = mix(out ^ parts[:, i])
    return out


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, n_shingles, set_id (null without words), bands."""

    def sketch(batches):
        for batch in batches:
            counts, sets, ends, hashes = [], [], [0], []
            for view in utf8_views(batch.column("text")):
                own = shingles(view, width)
                counts.append(len(own))
                if len(own):
                    sets.append(int(mix(np.cumsum(mix(own))[-1:] + np.uint64(len(own)))[0].astype(np.int64)))
                    hashes.append(bands(signature(own)))
                    ends.append(ends[-1] + len(hashes[-1]))
                else:
                    sets.append(None)
                    ends.append(ends[-1])
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sets, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["key", "doc_id", "n_shingles", "set_id", "bands"])

    return docs.mapInArrow(sketch, f"key long, doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set_id long, bands array<long>")


def links_within(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs with ``100 * common >= percent * union``; with ``side``, pairs of different sides only."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    group = np.arange(len(ids))
    marks = np.zeros(flat.max() + 1, np.int64)
    out = []
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if side is not None:
            rest = rest[side[rest] != side[i]]
        rest = rest[(100 * sizes[rest] >= percent * sizes[i]) & (percent * sizes[rest] <= 100 * sizes[i])]
        if not len(rest):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = 1
        if len(rest) * 2 > len(ids) - i - 1:  # most of them: sum over all that follow
            common = np.add.reduceat(marks[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])[rest - i - 1]
        else:
            common = np.array([marks[flat[starts[j] : starts[j] + sizes[j]]].sum() for j in rest])
        marks[own] = 0
        for j in rest[100 * common >= percent * (sizes[i] + sizes[rest] - common)]:
            if group[j] != group[i]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def _confirmed(members: DataFrame, width: int, percent: int) -> DataFrame:
    """``u, v``: links inside each task's group of ``part, side, set_id, text`` rows; a forest of each group."""

    def confirm(batches):
        part, ids, sets, sides = None, [], [], []

        def links():
            if len(set(ids)) < 2:
                return []
            keep = np.unique(np.array(ids), return_index=True)[1]
            side = np.array(sides)[keep]
            return links_within(np.array(ids)[keep], [sets[k] for k in keep], side if len(set(side.tolist())) > 1 else None, percent)

        for batch in batches:
            out = []
            for own, side, name, view in zip(batch.column("part").to_pylist(), batch.column("side").to_pylist(), batch.column("set_id").to_pylist(), utf8_views(batch.column("text")), strict=True):
                if own != part:
                    out += links()
                    part, ids, sets, sides = own, [], [], []
                ids.append(name)
                sets.append(shingles(view, width))
                sides.append(side)
            yield _edges(out)
        yield _edges(links())

    def _edges(out):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

    return members.repartition("part").sortWithinPartitions("part").mapInArrow(confirm, "u long, v long")


def group(docs: DataFrame, width: int = 4, percent: int = 80, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, n_shingles, component_id, is_first for each row of ``docs``.

    ``component_id`` is the least id of the documents reachable by links of
    ``100 * common >= percent * union``; ``key`` is a hash of the row's id and
    text; ``is_first`` marks one row's key of each group.
    """
    rows = keyed(docs, id_col, text_col)
    sketched = checkpointed(_sketches(rows, width))
    sets = sketched.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "key")).alias("first"), F.first("bands").alias("bands"), F.min("n_shingles").alias("n"))
    sets = checkpointed(sets.select("set_id", "least_id", F.col("first.key").alias("key"), "bands", "n"))
    held = sets.select("set_id", F.explode("bands").alias("band"))
    hubs = held.groupBy("band").agg(F.min("set_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    near = components(held.join(hubs, "band").where("set_id <> hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v")))
    near = checkpointed(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()))
    blocks = near.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    wanted = near.join(blocks, "root").join(sets.select("set_id", "key"), F.col("node") == F.col("set_id"))
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("set_id"), F.col("blocks"))).cast("int")
    placed = wanted.select("key", "set_id", "root", "blocks", own.alias("side"))
    spread = placed.select("key", "set_id", "root", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = spread.select("key", "set_id", "side", F.xxhash64("root", F.least("side", "other"), F.greatest("side", "other")).alias("part"))
    links = _confirmed(rows.select("key", "text").join(parts, "key").select("part", "side", "set_id", "text"), width, percent)
    found = components(links)
    least = sets.select("set_id", "least_id", "key").join(found, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    of_root = least.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(F.struct("least_id", "key")).alias("first"))
    of_set = least.join(of_root, "root").select("set_id", "component_id", F.col("first.key").alias("first_key"))
    named = sketched.select("key", "doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return named.select("key", "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("set_id").isNull() | (F.col("key") == F.col("first_key"))).alias("is_first"))
