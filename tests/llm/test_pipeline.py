"""Each stage of the pipeline on its predecessor's rows, against brute force."""

import pytest

import corpus_pipeline
from cohortveil.llm.tables import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        kept = spark.read.parquet(str(folder / name))
        out.append((name, docs, kept))
        docs = kept
    return {name: ([r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]) for name, before, after in out}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in stages.items():
        assert set(after[0]) == set(before[0]) | ({"copy"} if name == "source_mix" else set())


def test_quality_rules(stages, spark):
    before, after = stages["quality_rules"]
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    for r in before:
        n, _, _, _, again = brute.quality_base(r["text"])
        if n < 10 or 100 * again > 20 * n:
            assert r["doc_id"] not in kept
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    passed = {r["doc_id"] for r in before if (b := brute.quality_base(r["text"]))[0] >= 10 and 100 * b[4] <= 20 * b[0]}
    assert all((labels[i] == 1) == (i in kept) for i in passed & set(labels))


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    classes = brute.classes([(r["doc_id"], r["text"]) for r in before], 5, 80)  # stages take shingles of five words
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))


def test_near_duplicates_keep_null_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3, 4]


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    want = {}
    for r, (words, kept) in zip(before, brute.kept_words([r["text"] for r in before], 35), strict=True):
        if kept or not words:
            want[r["doc_id"]] = r["text"] if len(kept) == len(words) else " ".join(kept)
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_decontamination(stages, spark):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not brute.leaks(r["text"], items, 10)[1])


def test_source_mix(stages):
    before, after = stages["source_mix"]
    sizes, taken = {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.words(r["text"]))
    longest = max(len(brute.words(r["text"])) for r in before)
    for source, target in brute.mix_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 2 * longest
    assert max(r["copy"] for r in after) <= 2


def test_run_gives_the_last_stage(stages, spark):
    got = sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["copy"]) for r in stages["source_mix"][1])
