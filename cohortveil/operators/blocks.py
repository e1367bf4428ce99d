"""Samples by variants as dense blocks: one packed table under kinship, eigenvalues and components.

A row is a tile of samples by a block of variants, ``cohort, st, vb, ids, m``
(``ids``: the tile's samples in order, ``m``: their values, both as bytes).  It is
made from cells once and written; what follows multiplies blocks and never
shuffles cells.  Vectors over samples are rows ``cohort, st, ids, v``, vectors
over variants ``cohort, vb, v``, several vectors side by side in one matrix.
Where vectors are few enough (``SENT`` numbers) they are sent to the blocks;
beyond that both are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

TILE, BLOCK = 512, 2048
#: Numbers of a side's vectors that are sent to all tasks at most (128 MB).
SENT = 1 << 24
#: Sums of products that a task holds before it gives them away.
_HELD = 256
#: Samples of a tile where a panel is narrow, and what is narrow: copies of tiles for their pairs grow with the number of tiles.
WIDE_TILE, NARROW = 2048, 512


@dataclass(frozen=True)
class Blocks:
    """The table, the width of a block, how many variants there are in all, and bounds on samples and tiles (in all, and of a cohort)."""

    frame: DataFrame
    width: int
    variants: int
    samples: int
    tiles: int
    each: int = 1

    def of(self, condition: Column | str) -> Blocks:
        return replace(self, frame=self.frame.where(condition))


def numbers(column: pa.Array, nth: int, columns: int | None = None) -> np.ndarray:
    """One value of a binary column as doubles, in rows of ``columns``."""
    flat = np.frombuffer(column[nth].as_buffer(), np.float64)
    return flat if columns is None else flat.reshape(-1, columns)


def whole(column: pa.Array, nth: int) -> np.ndarray:
    return np.frombuffer(column[nth].as_buffer(), np.int64)


def packed(std: DataFrame, tile: int | None = None, block: int = BLOCK, tiles: int | None = None) -> Blocks:
    """Blocks of ``cohort, sample_idx, variant_idx, x``; cells that aren't there are 0.  ``tiles``: of a cohort, as another table has them."""
    told = std.groupBy("cohort").agg(F.countDistinct("sample_idx").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    variants, last = std.agg(F.countDistinct("variant_idx"), F.max("variant_idx")).first()
    width = max(1, min(block, (last or 0) + 1))
    tiles = tiles or max(1, math.ceil((told[0] or 0) / (tile or (WIDE_TILE if width <= NARROW else TILE))))
    cell = F.struct((F.col("variant_idx") % width).cast("int").alias("at"), F.col("x").cast("double").alias("x"))
    own = std.groupBy("cohort", F.col("sample_idx").cast("long").alias("sample_idx"), F.floor(F.col("variant_idx") / width).cast("int").alias("vb")).agg(F.collect_list(cell).alias("c"))
    own = own.select("cohort", F.pmod(F.xxhash64("sample_idx"), F.lit(tiles)).cast("int").alias("st"), "vb", "sample_idx", F.col("c.at").alias("at"), F.col("c.x").alias("x"))

    def dense(batches):
        key, ids, rows = None, [], []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.stack(rows).tobytes()])], names=["cohort", "st", "vb", "ids", "m"])

        for batch in batches:
            at, x = batch.column("at"), batch.column("x")
            for nth, (*own_key, sample) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cohort", "st", "vb", "sample_idx")), strict=True)):
                if own_key != key:
                    if ids:
                        yield made()
                    key, ids, rows = own_key, [], []
                row = np.zeros(width)
                row[at[nth].values.to_numpy()] = x[nth].values.to_numpy()
                ids.append(sample)
                rows.append(row)
        if ids:
            yield made()

    made = own.repartition("cohort", "st", "vb").sortWithinPartitions("cohort", "st", "vb", "sample_idx").mapInArrow(dense, "cohort string, st int, vb int, ids binary, m binary")
    return Blocks(kept(made), width, variants or 0, told[1] or 0, tiles * (told[2] or 0), tiles)


def gram(blocks: Blocks) -> dict[str, np.ndarray]:
    """For each cohort the variants' products summed over its samples, of a panel of one block; a matrix a cohort reaches the driver."""
    width = blocks.width

    def multiply(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for n, name in enumerate(batch.column("cohort").to_pylist()):
                m = numbers(batch.column("m"), n, width)
                sums[name] = sums[name] + m.T @ m if name in sums else m.T @ m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([0] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["cohort", "vb", "v"])

    parts = blocks.frame.select("cohort", "m").mapInArrow(multiply, "cohort string, vb int, v binary")
    return {r.cohort: np.frombuffer(r.v, np.float64).reshape(width, width) for r in _summed(parts, "cohort", "vb").collect()}


def narrow(blocks: Blocks, last: int = NARROW) -> bool:
    """Whether all variants are in one block, and few enough for a matrix of their products on the driver (2 MB a cohort)."""
    return blocks.width <= last and blocks.frame.where("vb > 0").isEmpty()


def _sent(vectors: DataFrame, size: int) -> DataFrame:
    """``vectors`` to be sent to all tasks if there are few enough numbers."""
    return F.broadcast(vectors) if size <= SENT else vectors


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts ``*keys, v`` (and ``ids``, the same for a key) added up by key."""
    with_ids = "ids" in parts.columns

    def add(batches):
        key, ids, total = None, None, None
        kinds = {"cohort": pa.string(), "st": pa.int32(), "vb": pa.int32()}

        def made():
            values = [pa.array([k], kinds[n]) for n, k in zip(keys, key, strict=True)] + ([pa.array([ids], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays([*values, pa.array([total.tobytes()])], names=[*keys, *(["ids"] if with_ids else []), "v"])

        for batch in batches:
            for nth, own in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                v = numbers(batch.column("v"), nth)
                if own != key:
                    if key is not None:
                        yield made()
                    key, total = own, np.array(v)
                    ids = batch.column("ids")[nth].as_py() if with_ids else None
                else:
                    total += v
        if key is not None:
            yield made()

    schema = ", ".join(f"{k} {'string' if k == 'cohort' else 'int'}" for k in keys) + (", ids binary" if with_ids else "") + ", v binary"
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def _products(joined: DataFrame, width: int, columns: int, transposed: bool) -> DataFrame:
    """Products of each block with its vectors, those of a task added up as far as it holds them."""
    keys = ("cohort", "vb") if transposed else ("cohort", "st")

    def told(sums):
        names, numbers_ = zip(*sums, strict=True)
        out = [pa.array(names, pa.string()), pa.array(numbers_, pa.int32())]
        if not transposed:
            out.append(pa.array([ids for ids, _ in sums.values()], pa.binary()))
        return pa.RecordBatch.from_arrays([*out, pa.array([v.tobytes() for _, v in sums.values()], pa.binary())], names=[*keys, *([] if transposed else ["ids"]), "v"])

    def multiply(batches):
        sums: dict = {}
        for batch in batches:
            for nth, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                m, v = numbers(batch.column("m"), nth, width), numbers(batch.column("v"), nth, columns)
                got = m.T @ v if transposed else m @ v
                if key in sums:
                    sums[key][1][:] += got
                else:
                    if len(sums) >= _HELD:
                        yield told(sums)
                        sums = {}
                    sums[key] = (None if transposed else batch.column("ids")[nth].as_py(), got)
        if sums:
            yield told(sums)

    return joined.mapInArrow(multiply, "cohort string, vb int, v binary" if transposed else "cohort string, st int, ids binary, v binary")


def times(blocks: Blocks, over_variants: DataFrame, columns: int, one: bool = False) -> DataFrame:
    """``cohort, st, ids, v``: each sample's products with ``vb, v``, which hold for all cohorts, or ``cohort, vb, v``.

    ``one``: all variants are in one block, so products are whole as they are and none is shuffled.
    """
    keys = [c for c in ("cohort", "vb") if c in over_variants.columns]
    cohorts = 1 if len(keys) == 1 else max(1, blocks.tiles)
    vectors = _sent(over_variants, cohorts * math.ceil(blocks.variants / blocks.width) * blocks.width * columns)
    products = _products(blocks.frame.join(vectors, keys), blocks.width, columns, False)
    return products if one else _summed(products, "cohort", "st")


def transposed_times(blocks: Blocks, over_samples: DataFrame, columns: int) -> DataFrame:
    """``cohort, vb, v``: each variant's products with ``cohort, st, ids, v``."""
    vectors = _sent(over_samples.select("cohort", "st", "v"), blocks.samples * columns)
    return _summed(_products(blocks.frame.join(vectors, ["cohort", "st"]), blocks.width, columns, True), "cohort", "vb")


def rows_of(blocks: Blocks) -> DataFrame:
    """``cohort, st, ids`` of each tile."""
    return blocks.frame.groupBy("cohort", "st").agg(F.min("ids").alias("ids"))


def changed(frame: DataFrame, change: Callable[[str, dict[str, np.ndarray]], dict[str, np.ndarray]], columns: dict[str, int], out: tuple[str, ...]) -> DataFrame:
    """A frame of vectors with matrices ``columns`` (and their widths) replaced by those that ``change(cohort, matrices)`` gives."""
    keys = [c for c in frame.columns if c not in columns]

    def move(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for n, name in enumerate(batch.column("cohort").to_pylist()):  # a row at a time: rows are matrices
                told = {c: numbers(batch.column(c), n, w) for c, w in columns.items() if w}
                rows = len(next(iter(told.values())))
                got = change(name, told | {c: np.zeros((rows, 0)) for c, w in columns.items() if not w})
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(n, 1) for k in keys), *(pa.array([np.ascontiguousarray(got[c]).tobytes()], pa.binary()) for c in out)], names=[*keys, *out])

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return frame.mapInArrow(move, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} binary" for c in out)]))


def inner(frame: DataFrame, left: str, right: str, widths: tuple[int, int]) -> dict[str, np.ndarray]:
    """For each cohort the inner products of the vectors in two columns, summed over all rows; only these reach the driver."""

    def multiply(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for n, name in enumerate(batch.column("cohort").to_pylist()):
                got = numbers(batch.column(left), n, widths[0]).T @ numbers(batch.column(right), n, widths[1])
                sums[name] = sums[name] + got if name in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["cohort", "v"])

    found: dict[str, np.ndarray] = {}
    for r in frame.select("cohort", *{left, right}).mapInArrow(multiply, "cohort string, v binary").collect():  # a small matrix a task and cohort
        got = np.frombuffer(r.v, np.float64).reshape(widths)
        found[r.cohort] = found[r.cohort] + got if r.cohort in found else np.array(got)
    return found


def noise(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers of a normal distribution by the hash of their keys: the same wherever they are made."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    state = np.zeros(np.broadcast_shapes(*(np.shape(k) for k in keys)), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            state = mixed((state ^ np.asarray(k).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        a, b = state, mixed(state + np.uint64(0x632BE59BD9B4E019))
    u, w = ((x >> np.uint64(11)).astype(np.float64) / 2.0**53 for x in (a, b))
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * w)
