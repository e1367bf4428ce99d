"""An extension beyond the batch work: running allele counts over a stream of VCF lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.vcf import dosage


def allele_counts(lines: DataFrame) -> DataFrame:
    """``chrom, pos, alt_alleles, calls`` summed over all lines so far, of a streaming (or static) ``value`` frame; complete or update mode."""
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select(f.alias("f")).where(F.size("f") >= 10)
    calls = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.explode(F.transform(F.slice("f", 10, 1 << 30), dosage)).alias("dosage"))
    return calls.groupBy("chrom", "pos").agg(F.sum("dosage").alias("alt_alleles"), F.count("dosage").alias("calls"))
