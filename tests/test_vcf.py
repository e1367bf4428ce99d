import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNotNull

from cohortveil.sources import vcf, vcf_source
from cohortveil.streaming.allele_counts import allele_counts

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
BODY = "15\t100\t.\tA\tC,G\t.\tPASS\t.\tGT\t0|1:35\t1/2\t./.\n" "15\t90\t.\tG\tT\t.\tPASS\t.\tGT\t1/1\t.\t./1\n" "short\t1\t.\tA\tC\t.\tPASS\t.\tGT\n" "chrX\t5\t.\tA\tC\t.\tPASS\t.\tGT\t1\t0\t2/2\n"


@pytest.mark.parametrize("call, want", [("0/0", 0), ("0|1:35", 1), ("1/1", 2), ("1/2", 3), ("2/2", 4), ("1", 1), ("./.", None), (".|.", None), ("./1", None), (".", None), ("", None)])
def test_calls(spark, call, want):
    assert spark.createDataFrame([(call,)], "c string").select(vcf.dosage(F.col("c")).alias("d")).first().d == want


def test_reading(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(HEAD + BODY)
    lines = vcf.read_lines(spark, str(tmp_path / "a.vcf.gz"))
    assert [r.sample_id for r in vcf.samples(lines).orderBy("sample_idx").collect()] == ["s1", "s2", "s3"]
    assert {tuple(r) for r in vcf.variants(lines).collect()} == {("15", 100, "A", "C"), ("15", 90, "G", "T"), ("chrX", 5, "A", "C")}
    got = {(r.sample_idx, r.variant_idx): r.dosage for r in vcf.read_genotypes(lines).collect()}
    assert [got[i, 0] for i in range(3)] == [1, 3, None] and [got[i, 2] for i in range(3)] == [1, 0, 4]
    auto = vcf.read_genotypes(lines, autosomes_only=True, all_alts=True)
    assert {(r.chrom, r.alt) for r in auto.select("chrom", "alt").distinct().collect()} == {("15", "C,G"), ("15", "T")}
    legend = tmp_path / "l.legend"
    legend.write_text("id position a0 a1\n15:90_G_T 90 G T\n15:90_G_T 90 G T\n")
    keep = vcf.legend_positions(vcf.read_lines(spark, str(legend)))
    assert [tuple(r) for r in keep.collect()] == [("15", 90)]
    assert {r.pos for r in vcf.read_genotypes(lines, keep_pos=keep).collect()} == {90}
    full = spark.createDataFrame([("15", 100, "A", "C")], "chrom string, pos int, ref string, alt string")
    assert {r.pos for r in vcf.read_genotypes(lines, keep_full=full, keep_pos=keep).collect()} == {100}
    assert vcf.read_genotypes(lines, keep_full=full.where("pos < 0")).count() == 0


def test_round_trip(spark, tmp_path):
    rows = [(i, j, "chr1", 10 * j, "A", "C", None if (i + j) % 5 == 0 else float((i * j) % 3)) for i in range(4) for j in range(6)]
    g = spark.createDataFrame(rows, "sample_idx int, variant_idx int, chrom string, pos int, ref string, alt string, dosage double")
    names = vcf.leaky_names(4, ["a", "b"])
    assert names == ["a_LEAKY0000", "b_LEAKY0001", "LEAKY_0002", "LEAKY_0003"]
    vcf.write_vcf(g, names, str(tmp_path / "out"), strip_chr=True)
    lines = vcf.read_lines(spark, str(tmp_path / "out"))
    back = vcf.read_genotypes(lines)
    assert {(r.sample_idx, r.variant_idx, r.pos, r.dosage) for r in back.collect()} == {(i, j, p, d) for i, j, _, p, _, _, d in rows}
    assert {r.chrom for r in back.collect()} == {"1"} and vcf.samples(lines).count() == 4


def test_stream_of_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.vcf").write_text(HEAD + BODY)
    stream = spark.readStream.text(str(folder))
    query = allele_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.pos, r.alt_alleles, r.calls) for r in spark.table("counts").collect()} == {(100, 4.0, 2), (90, 2.0, 1), (5, 5.0, 3)}


def test_cohorts_are_aligned_on_the_real_panel(spark, tmp_path):
    """Another order, a missing and a foreign variant, chr or not: cells follow the real file's variants."""
    from cohortveil.jobs import cohorts

    head = HEAD.replace("\ts3", "")
    real = head + "chr2\t7\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t1/1\n" "1\t5\t.\tG\tT\t.\tPASS\t.\tGT\t0/0\t./.\n" "1\t6\t.\tG\tT\t.\tPASS\t.\tGT\t1/1\t0/1\n"
    other = head + "1\t6\t.\tG\tT\t.\tPASS\t.\tGT\t0/1\t0/0\n" "1\t5\t.\tG\tA\t.\tPASS\t.\tGT\t1/1\t1/1\n" "chr2\t7\t.\tA\tC\t.\tPASS\t.\tGT\t1/1\t0/0\n"
    frames = []
    for name, text in (("real", real), ("other", other)):
        (tmp_path / f"{name}.vcf").write_text(text)
        frames.append(vcf.read_genotypes(vcf.read_lines(spark, str(tmp_path / f"{name}.vcf"))))
    got = {(r.cohort, r.sample_idx, r.variant_idx): (r.chrom, r.dosage) for r in cohorts.aligned(frames[0], {"SYN": frames[1]}).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "REAL"} == {(0, 0): ("2", 1), (1, 0): ("2", 2), (0, 1): ("1", 0), (1, 1): ("1", None), (0, 2): ("1", 2), (1, 2): ("1", 1)}
    assert {k[1:]: v for k, v in got.items() if k[0] == "SYN"} == {(0, 0): ("2", 2), (1, 0): ("2", 0), (0, 1): ("1", None), (1, 1): ("1", None), (0, 2): ("1", 1), (1, 2): ("1", 0)}
    with pytest.raises(ValueError):
        cohorts.aligned(frames[0], {"SYN": frames[1].where("pos < 0")})


def blocks_of(text, size):
    """BGZF: blocks of so many bytes of text, and the empty one at the end."""
    out = b""
    for piece in [*(text[i : i + size] for i in range(0, len(text), size)), b""]:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = pack.compress(piece) + pack.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


@pytest.mark.parametrize("kind", ["plain", "blocks", "gzip"])
def test_source_by_ranges(spark, tmp_path, kind):
    """Whatever the ranges' size, each line comes once, in order."""
    rng = random.Random(4)
    body = "".join(f"{rng.choice(('15', 'chr7', 'X'))}\t{i * 3}\t.\tA\t{rng.choice(('C', 'C,G'))}\t.\tPASS\t.\tGT\t" + "\t".join(rng.choice(("0/0", "0|1", "1/1", "./.")) for _ in range(rng.randrange(1, 40))) + "\n" for i in range(300))
    text = (HEAD + body).encode()[:-1]
    raw = {"plain": text, "blocks": blocks_of(text, 700), "gzip": gzip.compress(text)}[kind]
    (tmp_path / "a.vcf.bgz").write_bytes(raw)
    want = [tuple(line.split("\t", 9)) for line in body.splitlines()]
    for span in (64, 1000, 5000, 1 << 20):
        reader = vcf_source.Reader(str(tmp_path / "a.vcf.bgz"), span)
        got = [(r["chrom"], r["pos"], r["alts"], r["calls"]) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert got == [(w[0], int(w[1]), w[4], w[9]) for w in want], span
    assert vcf_source.sample_names(str(tmp_path / "a.vcf.bgz")) == ["s1", "s2", "s3"]
    source = vcf_source.variant_lines(spark, str(tmp_path / "a.vcf.bgz"), 5000)
    some = source.where("chrom = '15' and pos >= 100 and pos < 500")
    assert sorted(r.pos for r in some.collect()) == [int(w[1]) for w in want if w[0] == "15" and 100 <= int(w[1]) < 500]
    asked = vcf_source.Reader(str(tmp_path / "a.vcf.bgz"), 5000)
    assert list(asked.pushFilters([EqualTo(("chrom",), "15"), IsNotNull(("pos",))])) == [IsNotNull(("pos",))]
    assert sum(b.num_rows for part in asked.partitions() for b in asked.read(part)) == sum(w[0] == "15" for w in want)
    keep = spark.createDataFrame([("15", int(w[1])) for w in want if w[0] == "15"][::4], "chrom string, pos int")
    columns = ("sample_idx", "variant_idx", "chrom", "pos", "alt", "dosage")
    (tmp_path / "b.vcf").write_bytes(text)
    plain = sorted(map(str, vcf.read_genotypes(vcf.read_lines(spark, str(tmp_path / "b.vcf")), keep_pos=keep).select(*columns).collect()))
    assert plain == sorted(map(str, vcf.read_genotypes(source, keep_pos=keep).select(*columns).collect())) and plain


def test_parallel_writing_keeps_the_order(spark, tmp_path):
    rows = [(i, j, "1", 1000 - j, "A", "C", float((i + j) % 3)) for i in range(3) for j in range(400)]
    g = spark.createDataFrame(rows, "sample_idx int, variant_idx int, chrom string, pos int, ref string, alt string, dosage double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        vcf.write_vcf(g, ["a", "b", "c"], str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    for lines in (vcf.read_lines(spark, str(tmp_path / "out")), vcf_source.variant_lines(spark, str(tmp_path / "out"))):
        got = vcf.read_genotypes(lines).select("sample_idx", "variant_idx", "pos", "dosage").collect()
        assert sorted(map(tuple, got)) == sorted((i, j, p, d) for i, j, _, p, _, _, d in rows)


def test_the_names_line_is_made_in_a_task(spark, tmp_path):
    rows = [(i, 1, "1", 10, "A", "C", 1.0) for i in (10, 9, 100)]
    g = spark.createDataFrame(rows, "sample_idx int, variant_idx int, chrom string, pos int, ref string, alt string, dosage double")
    vcf.write_vcf(g, "X", str(tmp_path / "a"))
    vcf.write_vcf(g, ["X_9", "X_10", "X_100"], str(tmp_path / "b"))
    a, b = (sorted(r.value for r in spark.read.text(str(tmp_path / n)).collect()) for n in "ab")
    assert a == b and a[2].endswith("FORMAT\tX_9\tX_10\tX_100")
