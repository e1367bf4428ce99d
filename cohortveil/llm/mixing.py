"""Mixing sources to target weights by systematic sampling.

Within a source documents stand in a fixed order; each expects
``target / source size`` copies; the running sum of these, moved by one random
offset for the source, is cut at whole numbers, and a document is taken once
for each number that its piece crosses.  Documents are ordered by size, so the
words taken stay within about one long document of the target.

The running number of a document is put together from counts of cells
(source, size, slice of the id's hash), so no task orders a whole source.
A null source is a source of its own, the last; an empty table gives an empty
result; repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source_key, source_size, target`` of ``source_key, size`` rows; one row a source.

    Sources by code point take the weights in turn and share ``share`` times all
    sizes; a target stops at ``most`` times its source's size, and the others
    share what is left by weight.  A source is over its limit if it would be
    with all sources of a smaller limit by weight at theirs.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = weighed.withColumns({
        "wanted": F.sum("source_size").over(everything) * F.lit(float(share)) - most * F.coalesce(F.sum("source_size").over(before), zero),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero),
    })
    level = totals.withColumns({"own": F.col("weight") * F.col("wanted") / F.col("open"), "limit": (most * F.col("source_size")).cast("double")})
    capped = F.col("own") > F.col("limit")
    first_open = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), "source_key", "wanted", "open"))).over(everything)
    rest = F.col("weight") * first_open["wanted"] / first_open["open"]
    return level.select("source_key", "source_size", F.when(capped, F.col("limit")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: int = 1, slice_digits: int = 3, **how) -> DataFrame:
    """``docs`` with columns source_size, target (the source's, in words) and copies (how often the mix takes the row).

    Reruns take the same: the offset comes from the seed and the source's name.
    """
    source_key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col(source_col)))
    rows = docs.drop("source_size", "target", "copies")
    key, cut, before, nth = fresh(docs.columns, "_key", "_slice", "_before", "_nth")
    rows = rows.withColumns({key: source_key, cut: F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, slice_digits)})
    cells = rows.select(F.col(key).alias("source_key"), F.col(size_col).alias("size"), F.col(cut).alias("slice")).groupBy("source_key", "size", "slice").count()
    aim = targets(cells.select("source_key", (F.col("size") * F.col("count")).alias("size")), **how)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    by_size = cells.groupBy("source_key", "size").agg(F.sum("count").alias("n")).select("source_key", "size", F.coalesce(F.sum("n").over(up_to(Window.partitionBy("source_key").orderBy("size"))), zero).alias("before_size"))
    in_size = cells.select("source_key", "size", "slice", F.coalesce(F.sum("count").over(up_to(Window.partitionBy("source_key", "size").orderBy("slice"))), zero).alias("before_slice"))
    offsets = in_size.join(by_size, ["source_key", "size"]).join(aim, "source_key").select(F.col("source_key").alias(key), F.col("size").alias(size_col), F.col("slice").alias(cut), (F.col("before_size") + F.col("before_slice")).alias(before), "source_size", "target")
    numbered = rows.join(offsets, [key, size_col, cut]).withColumn(nth, F.col(before) + F.row_number().over(Window.partitionBy(key, size_col, cut).orderBy(id_col)))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    taken = F.floor(start + rate * F.col(nth)) - F.floor(start + rate * (F.col(nth) - 1))
    return numbered.withColumn("copies", F.least(taken, F.ceil(rate))).drop(key, cut, before, nth)
