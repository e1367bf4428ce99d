"""Array kernels for what is linear algebra: pair products, nearest neighbours, components and the top eigenvalue.

Pair products, components and eigenvalues multiply the packed table of
``blocks``; nearest neighbours deal points to tiles by a hash of their id.  A
task holds two tiles at a time, whatever the cohort's size and the panel's width.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .blocks import BLOCK, TILE, WIDE_TILE, Blocks, changed, gram, inner, narrow, noise, numbers, packed, rows_of, times, transposed_times, whole
from .eigen import leading, scaling


class _Pair:
    """Products of two tiles' samples (one tile with itself if they are the same), summed block by block."""

    def __init__(self, same: bool) -> None:
        self.same, self.ids, self.sums = same, [np.zeros(0, np.int64)] * 2, np.zeros((0, 0))

    def add(self, sides: list[tuple[np.ndarray, np.ndarray] | None]) -> None:
        """A block's matrices: the first tile's samples and values, and the second's."""
        if self.same:
            sides = [sides[0], sides[0]]
        if sides[0] is None or sides[1] is None:
            return  # one side has no calls here: products of 0
        ids = [np.union1d(old, new[0]) for old, new in zip(self.ids, sides, strict=True)]
        at = [np.searchsorted(now, old) for now, old in zip(ids, self.ids, strict=True)]
        if [len(x) for x in ids] != [len(x) for x in self.ids]:
            grown = np.zeros((len(ids[0]), len(ids[1])))
            grown[np.ix_(*at)] = self.sums
            self.ids, self.sums = ids, grown
        here = [np.searchsorted(now, side[0]) for now, side in zip(ids, sides, strict=True)]
        self.sums[np.ix_(*here)] += sides[0][1] @ sides[1][1].T

    def pairs(self, m: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.ids[0][:, None], self.ids[1][None, :]
        k = self.sums / m
        wanted = a <= b if self.same else np.ones(k.shape, np.bool_)
        if least is not None:
            wanted = wanted & ((k >= least - 1e-6) | (a == b))
        i, j = np.broadcast_arrays(a, b)
        return np.minimum(i, j)[wanted], np.maximum(i, j)[wanted], k[wanted]


#: Pairs, and values of pairs, that a task handles at once.
_ROWS = 1 << 17
#: Numbers of a tile of points that a task holds (8 MB), distances that it looks at together, and tiles that points are dealt to for the tasks' sake alone.
_HELD_NUMBERS, _DISTANCES, _SIDES = 1 << 20, 1 << 22, 4


def _dealt(frame: DataFrame) -> DataFrame:
    """Blocks copied to each pair of tiles that they are in, a pair's together, by block; ``second``: of the pair's second tile."""
    others = frame.select("cohort", F.col("st").alias("o")).distinct()  # a row a tile
    spread = frame.join(F.broadcast(others), "cohort")
    spread = spread.select("cohort", F.least("st", "o").alias("ta"), F.greatest("st", "o").alias("tb"), "vb", (F.col("st") > F.col("o")).alias("second"), "ids", "m")
    return spread.repartition("cohort", "ta", "tb").sortWithinPartitions("cohort", "ta", "tb", "vb")


def _paired(batches, width: int, drawn: int = 1):
    """(cohort, whether both tiles are one), their :class:`_Pair`, and the draws of both sides (rows of block -1, ``drawn`` wide), one pair of tiles after the other."""
    key, vb, pair, sides, draws = None, None, None, [None, None], [None, None]

    def settle():
        if vb == -1:
            draws[:] = sides
        else:
            pair.add(sides)

    for batch in batches:
        for nth, (cohort, ta, tb, own, second) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cohort", "ta", "tb", "vb", "second")), strict=True)):
            if ((cohort, ta, tb), own) != (key, vb):
                if pair:
                    settle()
                if (cohort, ta, tb) != key:
                    if pair:
                        yield (key[0], pair.same), pair, draws
                    key, pair, draws = (cohort, ta, tb), _Pair(ta == tb), [None, None]
                vb, sides = own, [None, None]
            sides[second] = (np.array(whole(batch.column("ids"), nth)), np.array(numbers(batch.column("m"), nth, drawn if own == -1 else width)))
    if pair:
        settle()
        yield (key[0], pair.same), pair, draws


def kinship_cells(blocks: Blocks, edges: Sequence[float], mult: DataFrame | None = None, real: str = "HO") -> DataFrame:
    """``cohort, b, own, k, n, mass``: pairs of a cohort counted by the largest of ``edges`` that their kinship reaches (``k``), without a row a pair.

    Pairs below all edges aren't told.  ``own``: of each sample with itself, whose
    number is ``n``.  Rows with ``b`` are of the draws that ``mult`` tells (``b,
    sample_idx, c``, b from 0) from the cohort ``real``: pairs with
    multiplicity, copies of one person as pairs of theirs; ``mass`` is the sum of
    their values.  Values are rounded to 9 places first, as in :func:`kinship`.
    """
    m, width, frame, told = blocks.variants, blocks.width, blocks.frame, np.array(sorted(set(edges)))
    drawing, draws = mult is not None, 1
    if drawing:
        draws += mult.agg(F.max("b")).first()[0] or 0
        picks = packed(mult.select(F.lit(real).alias("cohort"), "sample_idx", F.col("b").cast("int").alias("variant_idx"), F.col("c").cast("double").alias("x")), block=draws, tiles=blocks.each)
        frame = frame.unionByName(picks.frame.withColumn("vb", F.lit(-1)))

    def weights(ids: np.ndarray, side) -> np.ndarray:
        out = np.zeros((len(ids), draws))
        if side is not None and len(ids):
            at = np.minimum(np.searchsorted(ids, side[0]), len(ids) - 1)
            met = ids[at] == side[0]
            out[at[met]] = side[1][met]
        return out

    def count(batches):
        counts, people, by_draw, mass = {}, {}, np.zeros((len(told) + 1, draws)), np.zeros((len(told) + 1, draws))
        for (cohort, same), pair, drawn in _paired(batches, width, draws):
            rows, columns = pair.ids
            sums = counts.setdefault(cohort, np.zeros(len(told) + 1, np.int64))
            if same:
                people[cohort] = people.get(cohort, 0) + len(rows)
            weigh = drawing and cohort == real
            if weigh:
                a = weights(rows, drawn[0])
                b = a if same else weights(columns, drawn[1])
            step = max(1, _ROWS // max(1, len(columns)))
            for first in range(0, len(rows), step):
                k = np.round(pair.sums[first : first + step] / m, 9)
                at, to = np.nonzero(k >= told[0])
                value, at = k[at, to], at + first
                cell = np.searchsorted(told, value, "right")
                apart = rows[at] < columns[to] if same else np.ones(len(at), np.bool_)
                sums += np.bincount(cell[apart], minlength=len(sums))
                if weigh:
                    one = (rows[at] == columns[to]) if same else np.zeros(len(at), np.bool_)
                    pick = np.flatnonzero(apart | one)
                    pick = pick[np.argsort(cell[pick], kind="stable")]
                    if not len(pick):
                        continue
                    w = a[at[pick]] * np.where(one[pick, None], (b[to[pick]] - 1) / 2, b[to[pick]])
                    begin = np.flatnonzero(np.diff(cell[pick], prepend=-1))
                    by_draw[cell[pick[begin]]] += np.add.reduceat(w, begin)
                    mass[cell[pick[begin]]] += np.add.reduceat(w * value[pick, None], begin)
        out = [(c, None, True, None, float(n), None) for c, n in people.items()]
        out += [(c, None, False, float(told[e - 1]), float(n[e]), None) for c, n in counts.items() for e in np.flatnonzero(n)]
        out += [(real, int(d), False, float(told[e - 1]), float(by_draw[e, d]), float(mass[e, d])) for e, d in zip(*np.nonzero(by_draw), strict=True)]
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64())
        columns_ = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns_, kinds, strict=True)], names=["cohort", "b", "own", "k", "n", "mass"])

    found = _dealt(frame).mapInArrow(count, "cohort string, b int, own boolean, k double, n double, mass double")
    return found.groupBy("cohort", "b", "own", "k").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def kinship(std: DataFrame | Blocks, tile: int = TILE, block: int = BLOCK, least: float | None = None) -> DataFrame:
    """``cohort, i, j, k`` for i <= j: mean over all variants of the product of standardised values.

    With ``least``, of pairs of two samples only those of at least this value; a
    sample with itself is always there, so numbers of pairs follow from it.
    Blocks are copied to the tiles that their own meets.
    """
    blocks = std if isinstance(std, Blocks) else packed(std, tile, block)
    m, width = blocks.variants, blocks.width
    dealt = _dealt(blocks.frame)

    def products(batches):
        for (cohort, same), pair, _ in _paired(batches, width):
            i, j, k = pair.pairs(m, least)
            for at in range(0, len(i), _ROWS):
                part = slice(at, at + _ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([cohort] * len(i[part]), pa.string()), pa.array(i[part]), pa.array(j[part]), pa.array(k[part])], names=["cohort", "i", "j", "k"])

    found = dealt.mapInArrow(products, "cohort string, i long, j long, k double").withColumn("k", F.round("k", 9))
    return found if least is None else found.where((F.col("k") >= least) | (F.col("i") == F.col("j")))


def points(std: DataFrame, key: str = "variant_idx", value: str = "x") -> DataFrame:
    """``cohort, sample_idx, v``: each sample's values in the order of ``key``."""
    return std.groupBy("cohort", "sample_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("o"), F.col(value).alias("x")))), lambda s: s["x"]).alias("v"))


def tiles_of(known: DataFrame, tile: int, by: Sequence[str] = ()) -> int:
    """Tiles that :func:`nearest` deals points to."""
    most, wide = known.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("m")).agg(F.max("n"), F.max("m")).first()
    return min(max(1, math.ceil((most or 0) / tile)), max(_SIDES, math.ceil((most or 0) * (wide or 0) / _HELD_NUMBERS)))


def nearest(known: DataFrame, asked: Sequence[str] = ("HO",), to: Sequence[str] | None = None, manhattan: bool = False, tile: int = WIDE_TILE, by: Sequence[str] = ()) -> DataFrame:
    """``*by, asked, sample_idx, cohort, dd``: from each sample of the asked cohorts, the distance to the nearest one of every cohort (of ``to``, if given).

    ``known`` has ``cohort, sample_idx, v`` and, for several spaces at once, their
    names ``by`` (whole numbers).  A sample isn't its own neighbour; one of
    another cohort is, whatever its number.  Points are copied once a tile, so
    tiles are as large as a task may hold: ``tile`` points or more, up to
    ``_HELD_NUMBERS``, and ``_SIDES`` of them where there are fewer points.
    """
    tiles = tiles_of(known, tile, by)
    of = F.pmod(F.xxhash64("sample_idx"), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = known.where(F.col("cohort").isin(*asked)).select(*by, F.lit(True).alias("asks"), "cohort", "sample_idx", "v", of.alias("qt")).withColumn("rt", every)
    right = (known if to is None else known.where(F.col("cohort").isin(*to))).select(*by, F.lit(False).alias("asks"), "cohort", "sample_idx", "v", of.alias("rt")).withColumn("qt", every)

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if manhattan:
            out = np.zeros((len(a), len(b)))
            for i in range(a.shape[1]):
                out += np.abs(a[:, i, None] - b[None, :, i])
            return out
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T

    def least(part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], []]
        ask, have = part[part["asks"]], part[~part["asks"]]
        if len(ask) and len(have):
            a, ids, names = np.stack(ask["v"].to_numpy()), ask["sample_idx"].to_numpy(), np.array(ask["cohort"].tolist(), dtype=object)
            for cohort, rows in have.groupby("cohort"):
                b, own = np.stack(rows["v"].to_numpy()), rows["sample_idx"].to_numpy()
                step = max(1, _DISTANCES // len(b))
                for first in range(0, len(a), step):
                    some, name, number = (x[first : first + step] for x in (a, names, ids))
                    far = distance(some, b)
                    if (name == cohort).any():
                        far[(name[:, None] == cohort) & (number[:, None] == own[None, :])] = np.inf
                    at = far.argmin(1)
                    moved = some - b[at]
                    exact = np.abs(moved).sum(1) if manhattan else np.sqrt((moved**2).sum(1))  # free of the product's cancellation
                    met = np.flatnonzero(np.isfinite(far[np.arange(len(some)), at]))
                    for column, values in zip(out, (name[met].tolist(), number[met].tolist(), [cohort] * len(met), exact[met].tolist()), strict=True):
                        column += values
        kinds = (object, "int64", object, "float64")  # plain objects: Arrow's chunked texts don't go back to Spark
        told = pd.DataFrame({name: pd.Series(values, dtype=kind) for name, values, kind in zip(("asked", "sample_idx", "cohort", "dd"), out, kinds, strict=True)})
        for name in by:
            told[name] = np.full(len(told), part[name].iloc[0], np.int64)
        return told

    tasks = left.unionByName(right).groupBy(*by, "qt", "rt")  # two tiles at most, and the asked ones once more
    pairs = tasks.applyInPandas(least, "asked string, sample_idx long, cohort string, dd double" + "".join(f", {name} long" for name in by))
    return pairs.groupBy(*by, "asked", "sample_idx", "cohort").agg(F.round(F.min("dd"), 9).alias("dd"))


def distances_of(known: DataFrame, synthetic: str = "SYN", tile: int = WIDE_TILE, by: Sequence[str] = ()) -> DataFrame:
    """``*by, sample_idx, d_syn, d_real`` of each HO point of ``known``: to the nearest synthetic one and the nearest other HO one (Euclidean)."""
    least = lambda cohort: F.min(F.when(F.col("cohort") == cohort, F.col("dd")))
    return nearest(known.where(F.col("cohort").isin("HO", synthetic)), tile=tile, by=by).groupBy(*by, "sample_idx").agg(least(synthetic).alias("d_syn"), least("HO").alias("d_real"))


def distances(std: DataFrame, tile: int = TILE) -> DataFrame:
    """:func:`distances_of` over all variants."""
    return distances_of(points(std.where("cohort in ('HO', 'SYN')")), tile=tile)


def nearest_burden(burden: DataFrame, tile: int = WIDE_TILE) -> DataFrame:
    """``name, cohort, sample_idx, dist``: each real sample's least Manhattan distance to a sample of each synthetic cohort ``name``.

    ``burden`` has ``cohort, sample_idx, feature, value``.  Samples of equal
    burdens are one point, told apart by all their values, so pairs grow with
    distinct burdens and not with samples.
    """
    vectors = points(burden, "feature", "value")
    kinds = kept(vectors.groupBy("cohort", "v").agg(F.min("sample_idx").alias("sample_idx")))
    real = ("TR", "HO")
    names = [r.cohort for r in kinds.select("cohort").distinct().collect() if r.cohort not in real]  # one row a cohort
    found = nearest(kinds, asked=real, to=names or ["SYN"], manhattan=True, tile=tile)
    of_kind = found.select("asked", F.col("sample_idx").alias("least"), F.col("cohort").alias("name"), F.col("dd").alias("dist")).join(kinds.select(F.col("cohort").alias("asked"), F.col("sample_idx").alias("least"), "v"), ["asked", "least"])
    of_kind = of_kind.select("name", F.col("asked").alias("cohort"), "v", "dist")
    return vectors.where(F.col("cohort").isin(*real)).join(of_kind, ["cohort", "v"]).select("name", "cohort", "sample_idx", "dist")


def centred(std: DataFrame) -> Blocks:
    """Packed blocks of all cohorts with TRAIN's mean taken off each variant."""
    means = std.where("cohort = 'TR'").groupBy("variant_idx").agg(F.avg("x").alias("mean"))
    return packed(std.join(means, "variant_idx").select("cohort", "sample_idx", "variant_idx", (F.col("x") - F.col("mean")).alias("x")))


def _points(vectors: DataFrame, columns: int) -> DataFrame:
    """``cohort, sample_idx, v`` of ``cohort, st, ids, v``: an array a sample."""

    def unpack(batches):
        for batch in batches:
            for n, cohort in enumerate(batch.column("cohort").to_pylist()):
                ids, v = whole(batch.column("ids"), n), numbers(batch.column("v"), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * columns, pa.int32()), pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array([cohort] * len(ids), pa.string()), pa.array(ids), lists], names=["cohort", "sample_idx", "v"])

    return vectors.mapInArrow(unpack, "cohort string, sample_idx long, v array<double>")


def _over_variants(blocks: Blocks, v: np.ndarray) -> DataFrame:
    """``vb, v`` of a panel of one block."""
    return blocks.frame.sparkSession.createDataFrame([(0, bytearray(np.ascontiguousarray(v, np.float64).tobytes()))], "vb int, v binary")


def component_points(blocks: Blocks, k: int = 10, tolerance: float = 1e-10) -> DataFrame:
    """``cohort, sample_idx, v`` (at most k numbers): all samples of :func:`centred` blocks on TRAIN's leading components, fitted exactly.

    Where the panel is narrow, its variants' products are summed in one pass.  Else
    the covariance is never formed: the eigenvectors of the samples' products come
    from products with a few vectors.  Signs are the solver's.
    """
    train = blocks.of("cohort = 'TR'")
    if narrow(blocks):
        products = gram(train)
        if "TR" not in products:
            return blocks.frame.sparkSession.createDataFrame([], "cohort string, sample_idx long, v array<double>")
        values, axes = (x[..., ::-1][..., :k] for x in np.linalg.eigh(products["TR"]))
        v = np.zeros((blocks.width, k))
        v[:, : len(values)] = axes * (values > 1e-12 * values[0])
        return _points(times(blocks, _over_variants(blocks, v), k, True), k)
    values, vectors, found = leading(rows_of(train), lambda v, n: times(train, transposed_times(train, v, n), n), k, tolerance)
    if "TR" not in values:
        return blocks.frame.sparkSession.createDataFrame([], "cohort string, sample_idx long, v array<double>")
    top = values["TR"]
    scale = np.where(top > 1e-12 * top[0], 1 / np.sqrt(np.maximum(top, 1e-300)), 0.0)
    axes = changed(transposed_times(train, vectors, found), lambda cohort, m: {"v": m["v"] * scale}, {"v": found}, ("v",))
    return _points(times(blocks, kept(axes.select("vb", "v")), found), found)


def randomised_component_points(blocks: Blocks, fits: Sequence[tuple[int, int]], more: int = 10, power: int | None = None, cohorts: Sequence[str] | None = None) -> DataFrame:
    """``fit, cohort, sample_idx, v``: all samples (or those of ``cohorts``) on components by randomised fits, each (number of components, seed).

    Each fit sketches TRAIN's variants with its own normal numbers (by the hash of
    seed, variant and column), sharpens the sketch by ``power`` products with the
    data and back (7 for few components, else 4), and takes the components from
    the small matrix that is left.  All fits go through the same passes.
    """
    train = blocks.of("cohort = 'TR'")
    asked = blocks if cohorts is None else blocks.of(F.col("cohort").isin(*cohorts))
    samples = int(rows_of(train).agg(F.sum(F.length("ids"))).first()[0] or 0) // 8
    if not samples:
        return blocks.frame.sparkSession.createDataFrame([], "fit long, cohort string, sample_idx long, v array<double>")
    smaller = min(samples, blocks.variants)
    sizes = [min(k + more, smaller) for k, _ in fits]
    to = np.cumsum(sizes)
    spans = [slice(int(b) - n, int(b)) for b, n in zip(to, sizes, strict=True)]
    columns = int(to[-1])
    power = power if power is not None else 7 if max(k for k, _ in fits) < 0.1 * smaller else 4
    width = blocks.width

    def sketch(batches):
        for batch in batches:
            for vb in batch.column("vb").to_pylist():
                at = (vb * width + np.arange(width))[:, None]
                v = np.hstack([noise(seed, at, np.arange(n)[None, :]) for (_, seed), n in zip(fits, sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([vb], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["vb", "v"])

    def by_fit(grams: dict[str, np.ndarray], make) -> np.ndarray:
        out = np.zeros((columns, columns))
        for span in spans:
            out[span, span] = make(grams["TR"][span, span])
        return out

    def scaled(frame: DataFrame, by: np.ndarray) -> DataFrame:
        return changed(frame, lambda cohort, m: {"v": m["v"] @ by}, {"v": columns}, ("v",))

    if narrow(blocks):  # all passes go through the variants' products, which one pass over the samples sums
        products = gram(train)["TR"]
        v = np.hstack([noise(seed, np.arange(width)[:, None], np.arange(n)[None, :]) for (_, seed), n in zip(fits, sizes, strict=True)])

        def unit(v: np.ndarray, passes: int = 1) -> np.ndarray:
            for nth in range(passes):
                v = v @ by_fit({"TR": v.T @ products @ v}, lambda g, nth=nth: scaling(g, 1e-14 if nth == 0 else 1e-4))
            return v

        for _ in range(power):
            v = products @ unit(v)
        found = products @ unit(v, 2)
        last, kinds = _last({"TR": found.T @ found}, fits, spans, columns)
        return _of_fits(times(asked, _over_variants(blocks, found @ last), last.shape[1], True), last.shape[1], kinds)

    def orthonormal(frame: DataFrame, passes: int = 1) -> DataFrame:
        for nth in range(passes):
            frame = scaled(frame, by_fit(inner(frame, "v", "v", (columns, columns)), lambda g, nth=nth: scaling(g, 1e-14 if nth == 0 else 1e-4)))
        return frame

    base = kept(times(train, train.frame.select("vb").distinct().mapInArrow(sketch, "vb int, v binary"), columns))
    for _ in range(power):
        base = kept(times(train, transposed_times(train, orthonormal(base), columns), columns))
    base = kept(orthonormal(base, 2))
    found = kept(transposed_times(train, base, columns))
    last, kinds = _last(inner(found, "v", "v", (columns, columns)), fits, spans, columns)
    axes = kept(changed(found, lambda cohort, m: {"v": m["v"] @ last}, {"v": columns}, ("v",)).select("vb", "v"))
    return _of_fits(times(asked, axes, last.shape[1]), last.shape[1], kinds)


def _last(grams: dict[str, np.ndarray], fits: Sequence[tuple[int, int]], spans: list[slice], columns: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What takes all fits' sketches to their components, and each fit's number of these."""
    parts, kinds = [], []
    for nth, ((k, _), span) in enumerate(zip(fits, spans, strict=True)):
        values, vectors = np.linalg.eigh(grams["TR"][span, span])
        own = vectors[:, ::-1][:, :k] * np.where(values[::-1][:k] > 1e-20 * max(values[-1], 1e-300), 1 / np.sqrt(np.maximum(values[::-1][:k], 1e-300)), 0.0)
        part = np.zeros((columns, own.shape[1]))
        part[span] = own
        parts.append(part)
        kinds.append((nth, own.shape[1]))
    return np.hstack(parts), kinds


def _of_fits(products: DataFrame, columns: int, kinds: list[tuple[int, int]]) -> DataFrame:
    """``fit, cohort, sample_idx, v`` of all fits' components side by side."""
    every = _points(products, columns)
    starts = np.cumsum([0] + [n for _, n in kinds]).tolist()
    of_fit = F.explode(F.array(*(F.struct(F.lit(nth).cast("long").alias("fit"), F.slice("v", starts[nth] + 1, n).alias("v")) for nth, n in kinds)))
    return every.select("cohort", "sample_idx", of_fit.alias("f")).select("f.fit", "cohort", "sample_idx", "f.v")


def principal_components(std: DataFrame, k: int = 10) -> DataFrame:
    """``std`` replaced by k components, fitted on centred TRAIN: the same columns, a component for a variant."""
    return component_points(centred(std), k).select("cohort", "sample_idx", F.posexplode("v").alias("variant_idx", "x"))


def spectral(std: DataFrame | Blocks) -> DataFrame:
    """``cohort, trace, top, ratio``: the largest eigenvalue of each cohort's kinship against its trace.

    Kinship isn't formed: it is applied to a few vectors by way of the variants (a
    narrow panel's by their products, summed in one pass).
    """
    blocks = std if isinstance(std, Blocks) else packed(std)
    m = max(1, blocks.variants)
    if narrow(blocks):
        told = [(c, float(np.trace(g)) / m, max(0.0, float(np.linalg.eigvalsh(g)[-1])) / m) for c, g in sorted(gram(blocks).items())]
        return blocks.frame.sparkSession.createDataFrame([(c, trace, top, top / (trace + 1e-12)) for c, trace, top in told], "cohort string, trace double, top double, ratio double")
    values, _, _ = leading(rows_of(blocks), lambda v, n: changed(times(blocks, transposed_times(blocks, v, n), n), lambda cohort, x: {"v": x["v"] / m}, {"v": n}, ("v",)))
    top = blocks.frame.sparkSession.createDataFrame([(c, float(v[0])) for c, v in sorted(values.items())], "cohort string, top double")

    def squares(batches):
        for batch in batches:
            sums = [float((numbers(batch.column("m"), n) ** 2).sum()) / m for n in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("cohort"), pa.array(sums, pa.float64())], names=["cohort", "s"])

    trace = blocks.frame.select("cohort", "m").mapInArrow(squares, "cohort string, s double").groupBy("cohort").agg(F.sum("s").alias("trace"))
    return trace.join(F.broadcast(top), "cohort").select("cohort", "trace", "top", (F.col("top") / (F.col("trace") + 1e-12)).alias("ratio"))  # one row a cohort
