"""Connected components of an edge table, by union-find and alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed


def forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """(node, least node of its tree) of every node but the least ones, for the edges at hand."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _contract(batches):
    for batch in batches:
        nodes, roots = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins the larger neighbours of each node to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``u, v`` (long) but the roots; the root is a component's least node.

    Each batch of edges is first contracted to a forest by union-find; large and
    small stars then alternate until nothing changes, each written to the
    checkpoint folder.  Only two numbers a round reach the driver.
    """
    now = checkpointed(edges.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    told = mark(now)
    while told[0]:
        now = checkpointed(_small_star(_large_star(now)))
        before, told = told, mark(now)
        if told == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
