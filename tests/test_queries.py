"""Every query with SQL gives the same rows in DuckDB, at the smallest scale."""

import duckdb
import numpy as np
import pytest

from cohortveil import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "events"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


SLOW = {n for n in queries.SCORE_TEXT if n not in ("score_components", "score_calibrated", "kendall", "boot_weights")} | {"vcf_scores"}


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = sorted(got.columns)
    assert [got[c].dtype.kind == "f" for c in order] == [want[c].dtype.kind == "f" for c in order]
    got, want = (x[order].sort_values([c for c in order if x[c].dtype.kind != "f"] + [c for c in order if x[c].dtype.kind == "f"]).reset_index(drop=True) for x in (got, want))
    for c in order:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_written_cells_are_told_at_their_size_in_memory(spark):
    """Else a join that only looks at the file's size sends all cells to the driver; the tables of few rows a variant still look small."""
    job = queries.Job(spark, SF).keep().with_windows().with_std()
    told = lambda name: int(str(job.frames[name]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert told("geno") >= 24 * job.frames["geno"].count()  # three numbers a row
    assert max(told("af"), told("in_window"), told("value_count")) < 10 << 20


def test_all_pairs_are_not_written_before_they_are_returned(spark, monkeypatch):
    written = []
    monkeypatch.setattr(queries, "kept", lambda frame, own=queries.kept: written.append(frame.columns) or own(frame))
    found = queries.QUERIES["grm_pairs"](spark, SF)
    assert found.columns == ["cohort", "i", "j", "k"] and written and not any("j" in columns for columns in written)
