"""Cohorts from VCF files: aligned on the real panel's variants, numbered by it, and split into TRAIN and holdout."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Dialect, d
from ..operators.relations import Steps
from ..sources import vcf
from ..sources.shared import kept, shared_folder

_KEY = ("chrom", "pos", "ref", "alt")


def aligned(real: DataFrame, others: dict[str, DataFrame], strip_chr: bool = True) -> DataFrame:
    """``cohort, sample_idx, variant_idx, chrom, pos, dosage`` of the real cohort (REAL) and the others, over the real panel.

    Frames are as :func:`vcf.read_genotypes` gives them.  A variant of another
    cohort is the real one of equal chromosome, place and alleles, and takes its
    number; one that the panel doesn't have is left out, and one that a cohort
    doesn't have is missing in all its samples.  Of keys that a panel holds twice
    the first counts.  A cohort without any variant of the panel is an error.
    Chromosomes lose a leading ``chr``, without which haplotype windows and burdens
    by chromosome don't count them as autosomes; ``strip_chr=False`` leaves the
    names (and then ``chr15`` has neither).
    """
    first_of = lambda frame: kept(frame.groupBy(*_KEY).agg(F.min("variant_idx").alias("variant_idx")))  # noqa: E731 -- a row a variant, written: its told size is its own, so cells aren't shuffled to meet it
    panel = first_of(real).withColumn("bare", vcf.bare(F.col("chrom")) if strip_chr else F.col("chrom"))
    out = real.join(panel.select("variant_idx", F.col("bare").alias("chrom_")), "variant_idx").select(F.lit("REAL").alias("cohort"), F.col("sample_idx").cast("long").alias("sample_idx"), "variant_idx", F.col("chrom_").alias("chrom"), "pos", "dosage")
    for name, frame in others.items():
        first = frame.join(first_of(frame), [*_KEY, "variant_idx"], "left_semi")
        calls = first.join(panel.withColumnRenamed("variant_idx", "panel_idx"), list(_KEY)).select("sample_idx", F.col("panel_idx").alias("variant_idx"), "dosage")
        if calls.isEmpty():
            raise ValueError(f"{name} shares no variant with the real panel")
        every = calls.select("sample_idx").distinct().crossJoin(panel.select("variant_idx", F.col("bare").alias("chrom"), "pos"))  # one row a cell
        own = every.join(calls, ["sample_idx", "variant_idx"], "left").select(F.lit(name).alias("cohort"), F.col("sample_idx").cast("long").alias("sample_idx"), "variant_idx", "chrom", "pos", "dosage")
        out = out.unionByName(own)
    return out


def split(q: Dialect, share: float = 0.8, cohort: str = "") -> Steps:
    """``split(sample_idx, cohort)``: TRAIN for the given share of the real people, by the hash of their number, HO for the rest."""
    who = f"cohort = '{cohort}'" if cohort else "cohort in ('TR', 'HO')"
    return {
        "real_people": f"select distinct sample_idx from geno where {who}",
        "split": f"select sample_idx, case when row_number() over (order by {q.draw(f"'split:' || {q.text('sample_idx')}")}, sample_idx) <= floor(count(*) over () * {d(share)}) then 'TR' else 'HO' end as cohort from real_people",
    }


def divided(cohort: str = "REAL") -> Steps:
    """``divided``: the genotypes with the real cohort's samples named TR and HO by ``split``."""
    return {"divided": f"select coalesce(s.cohort, g.cohort) as cohort, g.sample_idx, g.variant_idx, g.chrom, g.pos, g.dosage from geno g left join split s on g.cohort = '{cohort}' and s.sample_idx = g.sample_idx"}


def written(genotypes: DataFrame, name: str, names: list[str] | None = None, **how) -> str:
    """The folder below the shared one to which genotypes were written as VCF text, samples in the order of their numbers."""
    path = f"{shared_folder(genotypes.sparkSession)}/vcf-{uuid.uuid4().hex}/{name}"
    vcf.write_vcf(genotypes.withColumns({"ref": F.lit("A"), "alt": F.lit("C")}), names or name, path, **how)
    return path


def through_vcf(genotypes: DataFrame, name: str) -> DataFrame:
    """Genotypes written as VCF text, its samples numbered from 0 in their order, and read again."""
    return kept(vcf.read_genotypes(vcf.read_lines(genotypes.sparkSession, written(genotypes, name))))
