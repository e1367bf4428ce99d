"""VCF and SNP legend text as DataFrames, and back.

A genotype row is ``sample_idx, variant_idx, chrom, var_chr, pos, ref, alt,
dosage`` (``var_chr``: the chromosome without ``chr``); a missing or unreadable
call is NULL, never NaN.  ``variant_idx`` follows the file's order, which the
haplotype windows depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dosage(call: Column) -> Column:
    """Sum of the allele numbers of a GT field; NULL if any part isn't a number."""
    parts = F.split(F.translate(F.get(F.split(call, ":"), F.lit(0)), "|", "/"), "/")
    return F.aggregate(F.transform(parts, lambda x: x.try_cast("int")), F.lit(0), lambda a, x: a + x).cast("double")


#: Kept lines whose numbers are sent to the tasks at most.
SENT_LINES = 1 << 20


def _numbered(lines: DataFrame) -> DataFrame:
    """``value, file, line``: each line's file and range, and a number that rises within it."""
    told = F.struct("file", "start") if {"file", "start"} <= set(lines.columns) else F.struct(F.lit("").alias("file"), F.shiftright(F.monotonically_increasing_id(), 33).alias("start"))
    return lines.select("value", told.alias("part"), F.monotonically_increasing_id().alias("nth"))


def consecutive(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in the order of ``part`` and ``nth``, which tell rows apart.

    Only these two are counted and ordered, a part a task at most; what else a row
    holds stays where it is, as the numbers are sent to it (up to ``SENT_LINES``,
    beyond that joined).
    """
    slim = rows.select("part", "nth")
    sizes = slim.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a part
    nth = F.row_number().over(Window.partitionBy("part").orderBy("nth")) - 1
    numbers = slim.select("part", "nth", nth.alias("_nth")).join(before, "part").select("part", "nth", (F.col("_before") + F.col("_nth")).cast("int").alias(name))
    few = (sizes.agg(F.sum("count")).first()[0] or 0) <= SENT_LINES
    return rows.join(F.broadcast(numbers) if few else numbers, ["part", "nth"]).drop("part", "nth")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain or gzipped text file or folder, with their file and the range of it that they were read in."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def fields_of(lines: DataFrame) -> DataFrame:
    """``part, nth, f`` of data lines with ten fields or more."""
    return _numbered(lines).where(~F.startswith("value", F.lit("#"))).select("part", "nth", F.split("value", "\t").alias("f")).where(F.size("f") >= 10)


def variants(lines: DataFrame) -> DataFrame:
    """Distinct ``chrom, pos, ref, alt``; of several ALT alleles the first."""
    return fields_of(lines).select(*_key(F.col("f"))).distinct()


def _key(f: Column, all_alts: bool = False) -> list[Column]:
    at = lambda i: F.get(f, F.lit(i))  # noqa: E731 -- null beyond the end, wherever the optimiser evaluates it
    alt = at(4) if all_alts else F.get(F.split(at(4), ","), F.lit(0))
    return [at(0).alias("chrom"), at(1).try_cast("int").alias("pos"), at(3).alias("ref"), alt.alias("alt")]


def samples(lines: DataFrame) -> DataFrame:
    """``sample_idx, sample_id`` of the header."""
    head = lines.where(F.startswith("value", F.lit("#CHROM"))).limit(1)
    return head.select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("sample_idx", "sample_id"))


def bare(chrom: Column) -> Column:
    """The chromosome's name without a leading ``chr``."""
    return F.regexp_replace(chrom, "^chr", "")


def autosome(chrom: Column) -> Column:
    """1 to 22, with or without ``chr``."""
    return bare(chrom).rlike("^[0-9]+$") & bare(chrom).try_cast("int").between(1, 22)


def read_genotypes(lines: DataFrame, keep_full: DataFrame | None = None, keep_pos: DataFrame | None = None, autosomes_only: bool = False, all_alts: bool = False) -> DataFrame:
    """Genotype rows of the kept variants; ``keep_full`` (by key) goes before ``keep_pos`` (by place).

    ``lines`` are text (:func:`read_lines`) or variants of the data source
    (``vcf_source.variant_lines``), which drops lines outside the kept places while
    it reads.  Variants are filtered before calls are parsed and exploded.  A key
    that occurs twice stays twice.
    """
    if "calls" in lines.columns:
        kept_places = keep_full if keep_full is not None else keep_pos
        rows = lines if kept_places is None else _within(lines, kept_places)
        rows = rows.select("part", "nth", "chrom", "pos", "ref", (F.col("alts") if all_alts else F.col("alt")).alias("alt"), F.split("calls", "\t").alias("calls"))
    else:
        rows = fields_of(lines).select("part", "nth", *_key(F.col("f"), all_alts), F.slice("f", 10, 1 << 30).alias("calls"))
    if autosomes_only:
        rows = rows.where(autosome(F.col("chrom")))
    if keep_full is not None:
        rows = rows.join(keep_full.select("chrom", "pos", "ref", "alt").distinct(), ["chrom", "pos", "ref", "alt"], "left_semi")
    elif keep_pos is not None:
        rows = rows.join(keep_pos.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    calls = consecutive(rows, "variant_idx").select("variant_idx", "chrom", "pos", "ref", "alt", F.posexplode("calls").alias("sample_idx", "call"))
    return calls.select("sample_idx", "variant_idx", "chrom", bare(F.col("chrom")).alias("var_chr"), "pos", "ref", "alt", dosage(F.col("call")).alias("dosage"))


def _within(variants_: DataFrame, places: DataFrame) -> DataFrame:
    """Variants on the places' chromosomes, between the least and the largest place: what the source can drop by itself."""
    found = places.groupBy("chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).collect()  # a row a chromosome
    if not found:
        return variants_.limit(0)
    return variants_.where(F.col("chrom").isin([r.chrom for r in found]) & (F.col("pos") >= min(r.low for r in found)) & (F.col("pos") <= max(r.high for r in found)))


def legend_positions(lines: DataFrame) -> DataFrame:
    """Distinct ``chrom, pos`` of a legend whose id (or first column) reads ``chrom:pos_...``; the header names the columns."""
    split = F.split(F.trim("value"), r"[\s,]+")
    told = _numbered(lines).select(F.struct("part", "nth").alias("line"), split.alias("f"))
    head = told.orderBy("line").limit(1).select(F.col("line").alias("head_line"), F.greatest(F.array_position("f", "id"), F.lit(1)).cast("int").alias("at"))
    ids = told.crossJoin(F.broadcast(head)).where("line <> head_line").select(F.element_at("f", F.col("at")).alias("id"))  # head is one row
    parts = F.split("id", ":")
    place = F.get(F.split(F.get(parts, F.lit(1)), "_"), F.lit(0)).try_cast("int")  # filters may be derived that meet the header too
    return ids.select(F.get(parts, F.lit(0)).alias("chrom"), place.alias("pos")).where("pos is not null").distinct()


def call_text(value: Column, phased: bool = False) -> Column:
    """The GT text of a dosage: missing, none, one or two alternative alleles."""
    sep = "|" if phased else "/"
    d = F.bround(value).cast("int")
    return F.when(value.isNull(), F.lit("./.")).when(d <= 0, F.lit(f"0{sep}0")).when(d == 1, F.lit(f"0{sep}1")).otherwise(F.lit(f"1{sep}1"))


def vcf_lines(genotypes: DataFrame, phased: bool = False, strip_chr: bool = False) -> DataFrame:
    """``variant_idx, value``: a data line for each variant, samples in order; sort by variant_idx to write."""
    chrom = bare(F.col("chrom")) if strip_chr else F.col("chrom")
    calls = F.array_sort(F.collect_list(F.struct("sample_idx", call_text(F.col("dosage"), phased).alias("gt"))))
    rows = genotypes.groupBy("variant_idx", chrom.alias("chrom"), "pos", "ref", "alt").agg(F.transform(calls, lambda c: c["gt"]).alias("gts"))
    fixed = [F.col("chrom"), F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT")]
    return rows.select("variant_idx", F.concat_ws("\t", *fixed, F.array_join("gts", "\t")).alias("value"))


def leaky_names(n: int, real: list[str]) -> list[str]:
    """Names of a leaky cohort's samples: the real ones' with a number, then numbers alone."""
    return [f"{real[i]}_LEAKY{i:04d}" if i < len(real) else f"LEAKY_{i:04d}" for i in range(n)]


def write_vcf(genotypes: DataFrame, names: list[str] | str, path: str, **how) -> None:
    """Writes a folder of text files whose names follow the variants' order: two header lines and the samples' line in the first, the variants in ranges over all of them.

    ``names``: the samples' names in order, or a text that each one's number
    follows.  Many tasks write; one file after the other is the VCF text.
    """
    spark, fixed = genotypes.sparkSession, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    if isinstance(names, str):  # the line is made in a task, as it grows with the samples
        numbers = F.array_sort(F.collect_list("sample_idx"))
        told = genotypes.select("sample_idx").distinct().select(F.transform(numbers, lambda s: F.concat(F.lit(f"\t{names}_"), s.cast("string"))).alias("told"))
        line = told.select(F.lit(-1).alias("variant_idx"), F.concat(F.lit(fixed), F.array_join("told", "")).alias("value"))
    else:
        line = spark.createDataFrame([(-1, "\t".join([fixed, *names]))], "variant_idx int, value string")
    top = spark.createDataFrame([(i - len(head) - 1, h) for i, h in enumerate(head)], "variant_idx int, value string")
    vcf_lines(genotypes, **how).unionByName(top).unionByName(line).repartitionByRange("variant_idx").sortWithinPartitions("variant_idx").select("value").write.mode("overwrite").text(path)
