"""Micro-cases worked out by hand, and cases whose answer the definition fixes."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortveil import queries
from cohortveil.functions.dialect import SPARK
from cohortveil.functions.scalars import calibrate, clamp01, noisy_or, p_format
from cohortveil.jobs import diagnostics, scoring
from cohortveil.operators import blocks, eigen, kernels
from cohortveil.operators import draws as array_draws
from cohortveil.operators import relations as rel

SMALL = "/root/testdata/sf0.01"


def run(spark, steps, select, **frames):
    own = {n: f"select * from {{{n}}}" for n in frames}
    return [r.asDict() for r in spark.sql(queries.chain(own | steps, select), **frames).collect()]


def geno(spark, cohorts):
    rows = [(c, 10 * k + i, j, "1", j, None if x is None else float(x)) for k, (c, matrix) in enumerate(cohorts.items()) for i, row in enumerate(matrix) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "cohort string, sample_idx long, variant_idx int, chrom string, pos int, dosage double")


def test_frequencies_and_standardised_values(spark):
    g = geno(spark, {"TR": [[0, 1, 2, 0], [1, 1, 2, 0], [2, None, 2, 0]]})
    p = {r["variant_idx"]: r["p"] for r in run(spark, rel.allele_frequency(), "select * from af", geno=g)}
    assert [p[j] for j in range(4)] == pytest.approx([0.5, 0.5, 1 - 1e-6, 1e-6])
    x = {(r["sample_idx"], r["variant_idx"]): r["x"] for r in run(spark, rel.allele_frequency() | rel.standardised(), "select * from std", geno=g)}
    assert [x[0, j] for j in range(4)] == pytest.approx([-1.414212, 0, 0.001413, -0.001413], abs=2e-6)
    assert x[2, 1] == 0
    assert {r["variant_idx"] for r in run(spark, rel.allele_frequency() | rel.standardised() | rel.polymorphic(), "select * from poly", geno=g)} == {0}


def test_kinship_kernel_with_many_tiles_and_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(11, 23))
    std = spark.createDataFrame([("HO", i, j, float(x[i, j])) for i in range(11) for j in range(23)], "cohort string, sample_idx long, variant_idx int, x double")
    for tile, block in ((512, 8192), (3, 7)):
        got = {(r.i, r.j): r.k for r in kernels.kinship(std, tile, block).collect()}
        want = x @ x.T / 23
        assert len(got) == 66 and all(got[i, j] == pytest.approx(want[i, j], abs=1e-8) for i, j in got)


def test_nearest_neighbours_with_exact_copies(spark):
    rng = np.random.default_rng(6)
    ho, syn = rng.normal(size=(7, 5)), rng.normal(size=(9, 5))
    syn[0] = ho[0]
    rows = [("HO", i, j, float(ho[i, j])) for i in range(7) for j in range(5)] + [("SYN", 100 + i, j, float(syn[i, j])) for i in range(9) for j in range(5)]
    std = spark.createDataFrame(rows, "cohort string, sample_idx long, variant_idx int, x double")
    for tile in (512, 4):
        got = {r.sample_idx: (r.d_syn, r.d_real) for r in kernels.distances(std, tile).collect()}
        assert got[0][0] == 0
        for i in range(7):
            others = np.delete(ho, i, 0)
            assert got[i] == pytest.approx((np.linalg.norm(syn - ho[i], axis=1).min(), np.linalg.norm(others - ho[i], axis=1).min()), abs=1e-8)


@pytest.mark.parametrize("n, m", [(3, 7), (40, 25), (30, 90)])
def test_top_eigenvalues_and_components(spark, n, m):
    """Against a dense solver: two cohorts at once, also with fewer samples than a block has vectors."""
    rng = np.random.default_rng(n)
    x = {"HO": rng.normal(size=(n, m)), "SYN": rng.normal(size=(n + 2, m)) @ np.diag(np.linspace(1, 1.02, m))}
    cells = [(c, i, j, float(v)) for c, rows in x.items() for (i, j), v in np.ndenumerate(rows)]
    std = spark.createDataFrame(cells, "cohort string, sample_idx long, variant_idx int, x double")
    for r in kernels.spectral(std).collect():
        k = x[r.cohort] @ x[r.cohort].T / m
        assert r.trace == pytest.approx(np.trace(k)) and r.top == pytest.approx(np.linalg.eigvalsh(k)[-1], rel=1e-6)
    train = std.withColumn("cohort", F.expr("case when cohort = 'HO' then 'TR' else cohort end"))
    most = min(4, n - 1)
    got = np.zeros((n + 2, most))
    for r in kernels.principal_components(train, most).where("cohort = 'SYN'").collect():
        got[r.sample_idx, r.variant_idx] = r.x
    _, _, axes = np.linalg.svd(x["HO"] - x["HO"].mean(0), full_matrices=False)
    want = (x["SYN"] - x["HO"].mean(0)) @ axes[:most].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_a_tiny_gap_needs_restarts_and_is_settled_or_an_error(spark):
    """More steps than a basis holds: it is restarted, or the solver says that it isn't done."""
    rng = np.random.default_rng(9)
    n = 60
    axes = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = np.concatenate(([1.0, 1.0 - 1e-4], np.linspace(0.9, 0.1, n - 2)))
    x = (axes * np.sqrt(values)) @ axes.T
    std = spark.createDataFrame([("HO", i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "cohort string, sample_idx long, variant_idx int, x double")
    table = blocks.packed(std, 16, 32)
    apply = lambda v, columns: blocks.times(table, blocks.transposed_times(table, v, columns), columns)
    found, vectors, k = eigen.leading(blocks.rows_of(table), apply, 2, 1e-8, width=2, most=5)
    assert np.allclose(found["HO"], values[:2], rtol=1e-9)
    got = np.zeros((n, 2))
    for r in vectors.collect():
        got[np.frombuffer(r.ids, np.int64)] = np.frombuffer(r.v).reshape(-1, k)
    assert np.allclose(np.abs(got), np.abs(axes[:, :2]), atol=1e-3)
    with pytest.raises(ArithmeticError):
        eigen.leading(blocks.rows_of(table), apply, 2, 1e-8, width=2, most=5, steps=2)


def test_randomised_components(spark):
    """Each seed's fit is near the exact one, and no two are the same; a fit alone is what it is among others."""
    rng = np.random.default_rng(12)
    x = {"TR": rng.normal(size=(60, 80)) * 3 * 0.6 ** np.arange(80), "HO": rng.normal(size=(5, 80))}
    std = spark.createDataFrame([(c, i, j, float(v)) for c, rows in x.items() for (i, j), v in np.ndenumerate(rows)], "cohort string, sample_idx long, variant_idx int, x double")
    table = kernels.centred(std)
    fits = [(3, 1), (3, 2), (5, 1)]
    got = {(r.fit, r.cohort, r.sample_idx): np.array(r.v) for r in kernels.randomised_component_points(table, fits, power=2).collect()}
    alone = {r.sample_idx: np.array(r.v) for r in kernels.randomised_component_points(table, [fits[1]], power=2).where("cohort = 'HO'").collect()}
    _, _, axes = np.linalg.svd(x["TR"] - x["TR"].mean(0), full_matrices=False)
    for fit, (k, _) in enumerate(fits):
        want = (x["HO"] - x["TR"].mean(0)) @ axes[:k].T
        for i in range(5):
            assert len(got[fit, "HO", i]) == k and np.allclose(np.abs(got[fit, "HO", i]), np.abs(want[i]), atol=0.05)
    assert all(np.allclose(np.abs(alone[i]), np.abs(got[1, "HO", i])) for i in range(5))
    assert not np.allclose(np.abs(got[0, "HO", 0]), np.abs(got[1, "HO", 0]), rtol=0, atol=1e-13)


def test_pairs_below_the_least_are_left_out(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 30))
    std = spark.createDataFrame([("SYN", i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "cohort string, sample_idx long, variant_idx int, x double")
    whole = {(r.i, r.j): r.k for r in kernels.kinship(std, 6, 7).collect()}
    some = {(r.i, r.j): r.k for r in kernels.kinship(std, 6, 7, 0.1).collect()}
    assert some == {p: k for p, k in whole.items() if k >= 0.1 or p[0] == p[1]} and len(whole) == 210


def test_equal_numbers_in_two_cohorts_are_two_samples(spark):
    """Holdout 0 and synthetic 0 are the same genome: an exact leak, not a sample and itself."""
    rows = [("HO", 0, 0.0, 0.0), ("HO", 1, 5.0, 5.0), ("SYN", 0, 0.0, 0.0), ("SYN", 1, 9.0, 9.0)]
    std = spark.createDataFrame([(c, i, j, v) for c, i, *x in rows for j, v in enumerate(x)], "cohort string, sample_idx long, variant_idx int, x double")
    for tile in (512, 1):
        got = {r.sample_idx: (r.d_syn, r.d_real) for r in kernels.distances(std, tile).collect()}
        assert got[0] == (0, pytest.approx(50**0.5)) and got[1] == (pytest.approx(32**0.5), pytest.approx(50**0.5))


def test_copies_of_samples_with_equal_numbers(spark):
    g = spark.createDataFrame([(c, i, 0, "1", 0, v) for c, i, v in (("TR", 0, 0.0), ("TR", 1, 1.0), ("HO", 0, 2.0), ("HO", 1, 2.0))], "cohort string, sample_idx long, variant_idx int, chrom string, pos int, dosage double")
    none = spark.createDataFrame([], "variant_idx int")
    from cohortveil.jobs import generators

    got = run(spark, generators.copycat(SPARK, 40, 1.0, 0.0, 0.0, 0.0), "select sample_idx, count(*) as n from leaky_geno group by sample_idx", geno=g, ultra=none)
    assert len(got) == 40 and all(r["n"] == 1 for r in got)


def test_proximity(spark):
    dist = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0), (4, 4.0, 3.0)], "sample_idx long, d_syn double, d_real double")
    (r,) = run(spark, rel.proximity(SPARK), "select * from pli", dist=dist)
    assert r["rho"] == pytest.approx(0.515) and r["r_p"] == pytest.approx(0.485) and r["a"] == 0.25 and r["r_a"] == 0.5 and r["pli"] == 0.5
    table = run(spark, diagnostics.per_sample(SPARK), "select * from per_sample order by sample_idx", dist=dist)
    assert [t["rank_margin"] for t in table] == [1, 2, 2, 4] and table[0]["ap_flag"]
    with pytest.raises(ValueError):
        diagnostics.plot_rows("size")


def test_histogram_similarity(spark):
    both = spark.createDataFrame([(0, 2.0, 1.0), (1, 1.0, 1.0), (2, 0.0, 1.0)], "t int, p double, q double")
    (r,) = run(spark, rel.js_similarity("src", (), "m"), "select * from m", src=both)
    assert r["m"] == pytest.approx(0.79248125, abs=1e-8)
    (r,) = run(spark, rel.js_similarity("src", (), "m"), "select * from m", src=both.withColumn("p", F.lit(0.0)))
    assert r["m"] == 0


def test_histogram_edges_are_left_closed_and_the_last_bin_closed(spark):
    values = [0.125, 0.14, 0.4999, 0.5, 0.9, 0.1]
    kin = spark.createDataFrame([("HO", 0, i + 1, v) for i, v in enumerate(values)], "cohort string, i long, j long, k double")
    got = {r["t"]: r["n"] for r in run(spark, rel.histogram(SPARK), "select * from hist where cohort = 'HO'", kin=kin)}
    assert got[0] == 1 and got[1] == 1 and got[24] == 3 and sum(got.values()) == 5


def test_haplotype_windows(spark):
    rows = [[0] * 8, [0] * 8, [1] * 8, [2] * 8, [2] * 8, [2] * 8]
    g = geno(spark, {"HO": rows})
    (r,) = run(spark, rel.haplotypes(SPARK), "select * from hap_collision", geno=g)
    assert r["mean_rho"] == pytest.approx(4 / 15) == r["max_rho"]
    prefixed = g.withColumn("chrom", F.lit("chr1"))
    (r,) = run(spark, rel.haplotypes(SPARK), "select * from hap_collision", geno=prefixed)
    assert r["mean_rho"] == 0
    # a missing dosage takes the most frequent value, the least of equals
    g = geno(spark, {"HO": [[2] * 8, [2] * 8, [0] * 8, [0] * 8, [None] + [0] * 7]})
    (r,) = run(spark, rel.haplotypes(SPARK), "select * from hap_collision", geno=g)
    assert r["mean_rho"] == pytest.approx((1 + 3) / 10)


def test_membership_auc(spark):
    burden = spark.createDataFrame([("TR", i, "global", float(v)) for i, v in enumerate((0, 1, 1, 3))] + [("HO", 10 + i, "global", float(v)) for i, v in enumerate((1, 2, 3))] + [("SYN", 20, "global", 0.0)], "cohort string, sample_idx long, feature string, value double")
    (r,) = run(spark, rel.membership(), "select * from mia", l1=kernels.nearest_burden(burden))
    assert r["auc"] == pytest.approx(0.708333, abs=1e-6)


def test_membership_tells_wide_vectors_apart(spark):
    """23 features: vectors that differ only in the first, values beyond 1,009, and two synthetic cohorts."""
    features = [f"{k:02d}" for k in range(23)]
    vectors = {("TR", 0): [0, 0] + [900] * 21, ("TR", 1): [3, 0] + [900] * 21, ("HO", 2): [1009, 0] + [7] * 21, ("HO", 0): [0, 1] + [7] * 21, ("SYN", 0): [0, 0] + [900] * 21, ("SYN", 5): [0, 1] + [7] * 21, ("OTHER", 9): [1, 1] + [7] * 21}
    burden = spark.createDataFrame([(c, i, f, float(x)) for (c, i), v in vectors.items() for f, x in zip(features, v, strict=True)], "cohort string, sample_idx long, feature string, value double")
    for tile in (512, 2):
        got = {(r.name, r.cohort, r.sample_idx): r.dist for r in kernels.nearest_burden(burden, tile).collect()}
        assert {k[1:]: v for k, v in got.items() if k[0] == "SYN"} == {("TR", 0): 0, ("TR", 1): 3, ("HO", 2): 1010, ("HO", 0): 0}
        assert {k[1:]: v for k, v in got.items() if k[0] == "OTHER"} == {("TR", 0): 2 + 893 * 21, ("TR", 1): 3 + 893 * 21, ("HO", 2): 1009, ("HO", 0): 1}


def test_draws_with_many_copies(spark):
    """A draw may hold one person more than 64 times."""
    mult = spark.createDataFrame([(0, 1, 200), (0, 2, 1)], "b int, sample_idx long, c long")
    dist = spark.createDataFrame([(1, 1.0, 2.0), (2, 9.0, 1.0)], "sample_idx long, d_syn double, d_real double")
    (r,) = run(spark, rel.proximity_draws(SPARK), "select count(*) as n, sum(d_syn) as s from dist_b", mult=mult, dist=dist)
    assert (r["n"], r["s"]) == (201, 209)


def test_without_draws(spark):
    kin = spark.createDataFrame([("HO", 0, 1, 0.2), ("SYN", 0, 1, 0.2)] + [(c, i, i, 1.0) for c in ("HO", "SYN") for i in (0, 1)], "cohort string, i long, j long, k double")
    steps = rel.tails((0.1,)) | rel.histogram(SPARK) | rel.kinship_excess((0.1,), 0) | rel.replay(0)
    (r,) = run(spark, steps, "select i.r, p.r_replay, p.obs, p.n_real_close, p.n_syn_close from ike i join replay p on p.name = i.name", kin=kin)
    assert (r["r"], r["obs"], r["n_real_close"], r["n_syn_close"]) == (1, pytest.approx(1), 1, 1) and r["r_replay"] == r["obs"]


def test_no_rare_variant(spark):
    g = geno(spark, {"TR": [[1, 1], [1, 2]], "SYN": [[1, 0], [0, 1]]})
    (r,) = run(spark, rel.train_maf(0) | rel.rare(1e-3) | rel.rare_carriers(1e-3), "select * from uniq", geno=g)
    assert (r["n_used"], r["u"], r["u0"], r["r_uniq"]) == (0, 0, 0, 0)


def test_maf_of_a_singleton(spark):
    g = geno(spark, {"TR": [[1]] + [[0]] * 299})
    (r,) = run(spark, rel.train_maf(1e-3), "select * from maf", geno=g)
    assert r["maf"] == pytest.approx(0.001668328, abs=1e-9) and r["nobs"] == 300


@pytest.mark.parametrize("values, weights, want", [((0.4, 0.6, None), (1, 1, 1), 0.44), ((None, None, None), (1, 1, 1), 0), ((0.5, 0.5, 0.5), (0, 0, 0), 0), ((0.5, None, 0.5), (1, 5, 1), 0.4375)])
def test_pooled_risk(spark, values, weights, want):
    text = noisy_or(tuple("cast(null as double)" if v is None else f"{v}D" for v in values), tuple(f"{w}D" for w in weights))
    assert spark.sql(f"select {text} as r").first().r == pytest.approx(want)


def test_clamp_and_calibration(spark):
    one = lambda x: spark.sql(f"select {x} as r").first().r
    assert one(clamp01("double('nan')")) == 1 and one(clamp01("cast(null as double)")) == 1 and one(clamp01("-3D")) == 0
    assert one(calibrate("0.5D", "0.2D", "0.8D")) == pytest.approx(50) and one(calibrate("0.5D", "0.6D", "0.6D")) == 0


def test_p_text(spark):
    got = spark.createDataFrame([(0.0,), (0.0123,), (1.0,), (0.00999,), (0.03446,), (0.996,)], "p double").select(p_format(F.col("p"), 1000).alias("t"), p_format(F.col("p")).alias("u")).collect()
    assert [r.t for r in got] == ["<1x10^-3", "1.2x10^-2", "1.0x10^0", "10.0x10^-3", "3.5x10^-2", "10.0x10^-1"] and got[0].u == "<1x10^-∞"


# Component scores of seven cohorts and what pooling makes of them.
TABLE = [
    ("GAN", "candidate", 0.301, 0.435, 0.271, 0.272335, 35.6539),
    ("RBM", "candidate", 0.345, 0.0317, 0.794, 0.569011, 75.7506),
    ("H1", "candidate", 0.828, 0.7504, 0.0390, 0.269274, 35.2402),
    ("H10", "candidate", 0.808, 0.7889, 0.024, 0.261187, 34.1473),
    ("H50", "candidate", 0.733, 0.8134, 0.035, 0.254214, 33.2048),
    ("safe", "safe anchor", 0.0, 0.0045, 0.012, 0.008531, 0.0),
    ("leaky", "leaky anchor", 1.0, 0.206, 1.0, 0.748433, 100.0),
]


def scores(spark, table=TABLE):
    return spark.createDataFrame([(n, role, i, p, k, t) for i, (n, role, p, k, t, *_) in enumerate(table)], "name string, role string, ord int, pli double, kri double, tli double")


def test_weights_and_scores(spark):
    fitted = [("safe", "safe anchor", 0.0, 0.007, 0.012), ("leaky", "leaky anchor", 1.0, 0.206, 1.0)]
    (w,) = run(spark, scoring.fit(SPARK), "select * from weights", scores=scores(spark, fitted))
    assert (round(w["w1"], 6), round(w["w2"], 6), round(w["w3"], 6)) == (0.22, 0.11, 0.67) and w["loss"] == pytest.approx(0.000637211, abs=1e-9)
    assert run(spark, scoring.grid(SPARK), "select count(*) as n from grid")[0]["n"] == 5116
    (best,) = run(spark, scoring.fold_fit(SPARK), "select * from weights", scores=scores(spark, fitted))
    assert best["w1"] == pytest.approx(0.22)
    weights = spark.createDataFrame([(22, 11, 0.22, 0.11, 0.67)], "i int, j int, w1 double, w2 double, w3 double")
    got = {r["name"]: (r["r_raw"], r["score"]) for r in run(spark, scoring.scored(), "select * from scored", scores=scores(spark), weights=weights)}
    for name, _, _, _, _, raw, score in TABLE:
        assert got[name] == pytest.approx((raw, score), abs=1e-4)


def test_the_first_anchor_of_a_role_counts(spark):
    more = TABLE + [("safe2", "safe anchor", 0.9, 0.9, 0.9, 0, 0), ("leaky2", "leaky anchor", 0.1, 0.1, 0.1, 0, 0)]
    one, two = (run(spark, scoring.fit(SPARK) | scoring.scored(), "select name, r_raw, score from scored where role = 'candidate' order by name", scores=scores(spark, t)) for t in (TABLE, more))
    assert one == two
    one, two = (run(spark, scoring.jittered(SPARK, 3), "select * from jit order by b", scores=scores(spark, t)) for t in (TABLE, more))
    assert one == two


def test_refitted_weights_follow_the_search(spark):
    """Every configuration's weights are those that its own fit finds, with the anchors as they are."""
    table = scores(spark)
    got = {(r["eps"], r["lam"], r["gamma"]): (r["w1"], r["w2"], r["w3"]) for r in run(spark, scoring.jittered(SPARK, 1, 0.0) | scoring.search(SPARK), "select * from best", scores=table)}
    assert len(got) == 60
    for eps, lam, gamma in list(got)[::13]:
        (w,) = run(spark, scoring.fold_fit(SPARK, eps, lam, gamma), "select w1, w2, w3 from weights", scores=table)
        assert got[eps, lam, gamma] == pytest.approx((w["w1"], w["w2"], w["w3"]))


def test_near_ties_go_to_smaller_or_more_even_weights(spark):
    """The pruned walk ends where a walk over the whole grid does, also where whole lines of the grid are near-ties."""
    tables = {"flat": [("safe", "safe anchor", 0.0, 0.0, 0.0), ("leaky", "leaky anchor", 1.0, 1.0, 1.0)], "two": [("safe", "safe anchor", 0.1, 0.1, 0.0), ("leaky", "leaky anchor", 0.9, 0.9, 0.2)], "other": [("safe", "safe anchor", 0.03, 0.1, 0.02), ("leaky", "leaky anchor", 0.9, 0.4, 0.8)]}
    for table in tables.values():
        safe, leaky = (np.array(row[2:]) for row in table)
        for gamma in (0.0, 1e-3):
            best = (None, np.inf, np.inf, 0.0)
            for i in range(101):
                for j in range(101):
                    w = np.array([i * 0.01, j * 0.01, 1 - i * 0.01 - j * 0.01])
                    if w[2] < 0:
                        continue
                    pool = lambda r, w=w: 1 - np.prod(1 - w / w.sum() * r)
                    loss, far, even = (pool(safe) - 0.02) ** 2 + (pool(leaky) - 0.75) ** 2 + gamma * (w**2).sum(), (w**2).sum(), -sum(x * math.log(x) for x in w if x > 0)
                    if loss + 1e-12 < best[1]:
                        best = ((i, j), loss, far, even)
                    elif abs(loss - best[1]) <= 1e-12 and (far + 1e-15 < best[2] or even > best[3] + 1e-12):
                        best = ((i, j), best[1], far, even)
            (got,) = run(spark, scoring.fold_fit(SPARK, gamma=gamma), "select * from weights", scores=scores(spark, table))
            assert (got["i"], got["j"]) == best[0], (table, gamma)


def test_a_given_table_is_scored(spark):
    table = scoring.listed(spark, [(n, p, k, t, r) for n, r, p, k, t, *_ in TABLE])
    got = {r["name"]: r["score"] for r in run(spark, scoring.given() | scoring.fit(SPARK) | scoring.scored(), "select * from scored", given=table)}
    assert got["safe"] == 0 and got["leaky"] == 100 and 0 < got["H1"] < 100
    order = {r["name"]: r["ord"] for r in run(spark, scoring.given(), "select * from scores", given=table)}
    assert [n for n, *_ in TABLE] == sorted(order, key=order.get)


def test_rank_agreement(spark):
    draw = spark.createDataFrame([(b, n, o, float(s)) for b, order in enumerate(("ABCD", "ABDC", "DCBA")) for o, (n, s) in enumerate(sorted((c, 10 - i) for i, c in enumerate(order)))], "b int, name string, ord int, score double")
    names = draw.select("name", "ord").distinct().withColumn("role", F.lit("candidate"))
    got = {r["b"]: r["tau"] for r in run(spark, scoring.rankings(SPARK), "select * from tau_b", draw=draw, scores=names)}
    assert got[0] == 1 and got[1] == pytest.approx(2 / 3) and got[2] == -1
    assert [r["ranking"] for r in run(spark, scoring.rankings(SPARK), "select ranking from rank_text order by b", draw=draw, scores=names)] == ["A > B > C > D", "A > B > D > C", "D > C > B > A"]


def test_synthetic_copy_of_the_holdout_is_the_worst_case(spark):
    rng = np.random.default_rng(3)
    ho = rng.integers(0, 3, (12, 20)).tolist()
    g = geno(spark, {"TR": rng.integers(0, 3, (9, 20)).tolist()})
    more = spark.createDataFrame([(c, base + i, j, "1", j, float(x)) for c, base in (("HO", 100), ("SYN", 200)) for i, row in enumerate(ho) for j, x in enumerate(row)], g.schema)
    std = spark.sql(queries.chain({"geno": "select * from {g}"} | rel.allele_frequency() | rel.standardised(), "select * from std"), g=g.unionByName(more))
    (r,) = run(spark, rel.proximity(SPARK), "select * from pli", dist=kernels.distances(std))
    assert r["rho"] == 0 and r["pli"] == 1


def test_known_values_on_the_small_tables(spark):
    q = queries.QUERIES
    rows = {r.cohort: r for r in q["grm_trace"](spark, SMALL).collect()}
    assert (rows["HO"].trace, rows["SYN"].trace, rows["HO"].pairs) == (83.53142, 83.19115, 5050)
    assert [round(r.f0, 6) for r in q["ike_risk"](spark, SMALL).orderBy("theta").collect()] == [0.166071, 0.120071, 0.014697]
    assert q["mia_auc"](spark, SMALL).first().auc == 0.486667
    r = q["uniq_collision"](spark, SMALL).first()
    assert (r.n_used, r.u, r.u0, r.r_uniq) == (8, 0, 0.193258, 0)
    assert q["replay_js"](spark, SMALL).first().m == 0.984892
    assert math.isclose(q["pli_pca"](spark, SMALL).first().pli, 0.13, abs_tol=0.2)


def test_pairs_are_counted_by_edges_without_a_row_each(spark):
    """Counts by cell are those of all pairs, of draws with multiplicity, for tiles of any size; values on an edge reach it."""
    rng = np.random.default_rng(5)
    std = spark.createDataFrame([(c, 10 * i + 1, j, float(x)) for c, n in (("HO", 13), ("SYN", 9)) for i in range(n) for j, x in enumerate(rng.normal(size=6))], "cohort string, sample_idx long, variant_idx int, x double")
    mult = spark.createDataFrame([(b, 10 * i + 1, int(c)) for b in range(3) for i, c in enumerate(rng.integers(0, 4, 13)) if c], "b int, sample_idx long, c long")
    every = kernels.kinship(std, 4, 6).toPandas()
    told = sorted([0.1, float(every.k[every.k > 0.2].iloc[0]), 0.5])
    cell = np.searchsorted(told, every.k, "right")
    c = {(r.b, r.sample_idx): r.c for r in mult.collect()}
    for tile, block in ((None, 2048), (4, 6), (5, 4)):
        table = blocks.packed(std, tile, block)
        got = kernels.kinship_cells(table, told, mult).toPandas()
        assert dict(got[got.own].groupby("cohort").n.sum()) == {"HO": 13, "SYN": 9}
        for cohort in ("HO", "SYN"):
            for e, low in enumerate(told, 1):
                some = got[(got.cohort == cohort) & ~got.own & got.b.isna() & (got.k == low)]
                assert some.n.sum() == ((every.cohort == cohort) & (every.i < every.j) & (cell == e)).sum()
        for b in range(3):
            w = np.array([(c.get((b, r.i), 0) * (c.get((b, r.i), 0) - 1) / 2 if r.i == r.j else c.get((b, r.i), 0) * c.get((b, r.j), 0)) * (r.cohort == "HO") for r in every.itertuples()])
            for e, low in enumerate(told, 1):
                some = got[(got.b == b) & (got.k == low)]
                assert some.n.sum() == w[cell == e].sum() and some.mass.sum() == pytest.approx((w * every.k)[cell == e].sum(), abs=1e-9)


def test_kinship_queries_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(kernels, "kinship", lambda *a, **k: pytest.fail("a row a pair"))
    for name in ("grm_trace", "kin_hist", "replay_js", "boot_kin", "kri_no_draws", "value_boot", "kri_breakdown"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_narrow_panels_take_one_pass(spark, monkeypatch):
    """Eigenvalues and components of a narrow panel come from its variants' products, and are those of the solver."""
    rng = np.random.default_rng(6)
    std = spark.createDataFrame([(c, i, j, float(x)) for c, n in (("TR", 30), ("HO", 8)) for i in range(n) for j, x in enumerate(rng.normal(size=12))], "cohort string, sample_idx long, variant_idx int, x double")
    table = kernels.centred(std)
    got = {}
    for way in (True, False):
        monkeypatch.setattr(kernels, "narrow", lambda blocks, way=way: way)
        if way:
            monkeypatch.setattr(kernels, "leading", lambda *a, **k: pytest.fail("the solver ran"))
        got[way] = {(r.cohort, r.sample_idx): np.array(r.v) for r in kernels.component_points(table, 4).collect()}, {r.cohort: (r.trace, r.top, r.ratio) for r in kernels.spectral(table).collect()}
        monkeypatch.undo()
    (a, spec), (b, want) = got[True], got[False]
    assert set(a) == set(b) and all(np.allclose(np.abs(a[x]), np.abs(b[x]), atol=1e-7) for x in a)
    assert set(spec) == set(want) and all(spec[x] == pytest.approx(want[x], rel=1e-9) for x in spec)


def test_value_draws_are_dealt_in_runs(spark, monkeypatch):
    """Draws that need more values than a row can hold: a cohort's pairs are met in runs, and picks are the same."""
    cells = [("HO", True, None, 300), ("SYN", True, None, 300), ("HO", False, 0.1, 900), ("SYN", False, 0.1, 700), ("HO", False, 0.25, 90), ("SYN", False, 0.14, 70)]
    kin_n = spark.createDataFrame(cells, "cohort string, own boolean, k double, n long")
    found = []
    for slots in (1 << 16, 1000):
        monkeypatch.setattr(rel, "_SLOTS", slots)
        steps = rel.tails((0.1, 0.25)) | rel.histogram(SPARK) | rel.value_draws(SPARK, 2, (0.1, 0.25))
        steps.pop("kin_n")
        found.append(sorted(map(str, run(spark, steps, "select * from value_null", kin_n=kin_n))))
    assert found[0] == found[1] and len(found[0]) == 3


def test_membership_orders_distinct_distances_only(spark):
    l1 = spark.createDataFrame([("SYN", "TR" if i % 3 else "HO", i, float(i * i % 7)) for i in range(60)], "name string, cohort string, sample_idx long, dist double")
    told = spark.sql("select * from {l1}", l1=l1).toPandas()
    mid = (-told.dist).rank(method="average")
    t, h = (told.cohort == "TR").sum(), (told.cohort == "HO").sum()
    (r,) = run(spark, rel.membership(), "select * from mia", l1=l1)
    assert r["auc"] == pytest.approx((mid[told.cohort == "TR"].sum() - t * (t + 1) / 2) / (t * h))
    (n,) = run(spark, rel.membership(), "select count(*) as n from ranked", l1=l1)
    assert n["n"] == told.dist.nunique()


def test_narrow_panels_send_no_vectors_of_samples(spark, monkeypatch):
    """On a panel of few variants neither eigenvalues nor components go by vectors over samples, which were sent to the driver and back step after step."""
    rng = np.random.default_rng(5)
    std = spark.createDataFrame([(c, i, j, float(v)) for c in ("TR", "HO") for (i, j), v in np.ndenumerate(rng.normal(size=(30, 6)))], "cohort string, sample_idx long, variant_idx int, x double")

    def refuse(*args, **named):
        raise AssertionError("vectors over samples")

    for name in ("leading", "transposed_times"):
        monkeypatch.setattr(kernels, name, refuse)
    assert kernels.spectral(std).count() == 2
    assert kernels.component_points(kernels.centred(std), 3).count() == 60


def test_draws_by_arrays_are_those_of_the_text(spark):
    """Keys over several powers of ten and both sides of a word's end; counts by cell as the text's own picks."""
    for head, first, n in (("v:replay:0:", 0, 11_000), ("v:excess:19:", 99_990, 30), ("v:excess:7:", 12_345_678_900, 2000), ("x", 9, 3), ("abcdefg", 95, 20)):
        want = [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in range(first, first + n)]
        assert np.concatenate(list(array_draws.draws(head, first, n))).tolist() == want
        for have in (7, 2**32 - 1, 2**32, 7_500_000_000):
            edges = np.array([(have + 1) // 2, have])
            below = sum(x % have < edges[0] for x in want)
            assert array_draws.picked(head, first, n, have, edges).tolist() == [below, n - below]
    cells = [("HO", True, None, 300), ("SYN", True, None, 300), ("HO", False, 0.1, 900), ("SYN", False, 0.1, 700), ("HO", False, 0.25, 90), ("SYN", False, 0.14, 70)]
    kin_n = spark.createDataFrame(cells, "cohort string, own boolean, k double, n long")
    steps = rel.tails((0.1, 0.25)) | rel.histogram(SPARK) | rel.value_draws(SPARK, 2, (0.1, 0.25)) | rel.value_runs()
    steps.pop("kin_n")
    told = "name, kind, b, cell, n, size"
    want = sorted(map(str, run(spark, steps, f"select {told} from cell_b", kin_n=kin_n)))
    runs = spark.sql(queries.chain({"kin_n": "select * from {kin_n}"} | steps, "select * from run"), kin_n=kin_n)
    assert sorted(str(r.asDict()) for r in array_draws.cells_drawn(runs).select(*told.split(", ")).collect()) == want


def test_points_are_copied_few_times(spark, monkeypatch):
    """Narrow points meet in few large tiles, and a tile's distances are looked at in parts; of points as wide as a task may hold there are more tiles."""
    rng = np.random.default_rng(8)
    rows = [(c, 1000 * k + i, [float(x) for x in rng.normal(size=3)]) for k, c in enumerate(("HO", "SYN")) for i in range(60)]
    known = spark.createDataFrame(rows, "cohort string, sample_idx long, v array<double>")
    x = {c: np.array([v for name, _, v in rows if name == c]) for c in ("HO", "SYN")}
    far = {c: np.sqrt(((x["HO"][:, None] - x[c][None]) ** 2).sum(2)) + (np.diag([np.inf] * 60) if c == "HO" else 0) for c in x}
    copied = []
    for held, together in ((1 << 20, 1 << 22), (36, 70)):
        monkeypatch.setattr(kernels, "_HELD_NUMBERS", held)
        monkeypatch.setattr(kernels, "_DISTANCES", together)
        pairs = kernels.nearest(known, tile=4)
        got = {(r.sample_idx, r.cohort): r.dd for r in pairs.collect()}
        assert all(got[i, c] == pytest.approx(far[c][i].min(), abs=1e-8) for i in range(60) for c in x)
        copied.append(kernels.tiles_of(known, 4))
    assert copied == [4, 10]
