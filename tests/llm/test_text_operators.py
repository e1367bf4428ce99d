"""Operators on documents against brute force, with nulls, empty and long texts, ties and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from cohortveil.llm import decontaminate, mixing, near_dup, quality, substring_dedup
from cohortveil.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ka", "lo", "mé", "ti", "Z", "q") for b in ("", "na", "ß", "ro", "9", "!")]


def prose(rng, n):
    return rng.choice((" ", "\n", "\t")).join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    w = text.split()
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else x for x in w)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice((3, 40, 80, 300))) for _ in range(25)]
    texts = base + [edited(rng, rng.choice(base), rng.choice((0.0, 0.01, 0.03, 0.06))) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(8)]
    texts += [None, "", " \n ", "one", "one", prose(rng, 4000), passage + " " + passage]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in docs], SCHEMA).repartition(parts)


@pytest.mark.parametrize("most", [50_000, 2])
def test_substring_dedup(spark, most):
    docs = corpus() + [(5, corpus()[5][1])]  # a repeated row
    got = substring_dedup.remove_repeats(frame(spark, docs), window=20, gram=8, most_segments=most).collect()
    want = sorted((i, len(w), len(w) - len(k), " ".join(k)) for (i, _), (w, k) in zip(docs, brute.kept_words([t for _, t in docs], 20), strict=True))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got) and got[0].lang == "en"


def test_substring_dedup_of_rows_repeated_whole(spark):
    docs = corpus() + 3 * corpus()[:12] + 2 * corpus()[12:16]
    got = substring_dedup.remove_repeats(frame(spark, docs, 1), window=20, gram=8, most_segments=2).collect()
    want = sorted((i, len(w), len(w) - len(k), " ".join(k)) for (i, _), (w, k) in zip(docs, brute.kept_words([t for _, t in docs], 20), strict=True))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want


def test_substring_dedup_edges(spark):
    empty = frame(spark, corpus()).limit(0)
    assert substring_dedup.remove_repeats(empty).count() == 0
    clash = frame(spark, [(1, "a b"), (None, None)]).withColumns({"key": F.lit(1), "n_words": F.lit(9), "part": F.lit(2), "anchor": F.lit(3), "_key": F.lit(4), "_found": F.lit(5), "_anchors": F.lit(6)})
    assert sorted((r.n_words, r._key, r._found, r._anchors) for r in substring_dedup.remove_repeats(clash).collect()) == [(0, 4, 5, 6), (2, 4, 5, 6)]
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(empty, window=5, gram=4)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, limit):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice((3, 9, 10, 25)))) for k in range(12)] + [(40, None), (41, ""), (None, prose(rng, 12)), (3, "one two")]
    docs = [(i, prose(rng, 40) + " " + (items[i % 12][1] or "") + (" " + prose(rng, 20) if i % 3 else "")) for i in range(30)] + corpus(2)[:20] + [(90, None), (91, ""), (92, "one, TWO")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, docs), bench, broadcast_windows=limit).collect()
    want = []
    for i, t in docs:
        n, hit, found = brute.leaks(t, [x for x in items if x[0] is not None], 10)
        want.append((i, n, len(hit), sorted(map(str, found))))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    clash = frame(spark, docs[:5]).withColumns({"_text": F.lit(1), "_key": F.lit(2), "_row": F.lit(3), "spans": F.lit(4)})
    told = decontaminate.find_leaks(clash, bench, broadcast_windows=limit, carry=clash.columns).collect()
    assert len(told) == 5 and {(r._text, r._key, r._row) for r in told} == {(1, 2, 3)}
    none = decontaminate.find_leaks(frame(spark, docs), bench.limit(0), broadcast_windows=limit)
    assert none.agg(F.max("n_hit")).first()[0] == 0


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, block):
    rng = random.Random(9)
    base = prose(rng, 120)
    docs = corpus(3) + [(200 + i, edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.04, 0.08)))) for i in range(60)]
    got = near_dup.group(frame(spark, docs), block=block).collect()
    want = brute.classes(docs, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(docs)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute.shingle_set(t, 4)) for i, t in docs}
    assert {r.doc_id for r in got if r.is_first} == set(want.values())


def test_near_duplicates_edges(spark):
    assert near_dup.group(frame(spark, []) if False else frame(spark, corpus()).limit(0)).count() == 0
    docs = frame(spark, [(7, "a b c d e"), (7, "a b c d e"), (3, "A b c d e"), (None, "a b c d e"), (1, None), (2, "")]).withColumn("key", F.lit("x"))
    got = near_dup.group(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (1, 1), (2, 2), (3, 3), (7, 3), (7, 3)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    good = [(i, prose(rng, 60) + ".") for i in range(40)]
    bad = [(100 + i, " ".join(w.upper() + "###" for w in prose(rng, 60).split())) for i in range(20)]
    odd = [(200, None), (201, ""), (202, "a a a a a a a a a a a a"), (203, "x\nx\n\n\ny # x\nx"), (204, "short")]
    docs = good + bad + odd + [(0, good[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in bad[:10]] + [(None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, docs).withColumns({"kept": F.lit(1), "trusted": F.lit(0)}), labels).collect()
    for i, t in docs:
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality_base(t), i
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (i < 100), i
    assert len(got) == len(docs)
    assert all(r.kept != r.base_failed for r in quality.judge(frame(spark, docs), labels.limit(0)).collect())
    assert quality.judge(frame(spark, docs).limit(0), labels).count() == 0


def test_quality_with_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)]).withColumns({"_text": F.lit(7), "llr": F.lit(8)})
    got = quality.judge(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), carry=docs.columns).collect()
    assert sorted((r.doc_id, r._text, r.n_words) for r in got) == [(1, 7, 3), (2, 7, 0)]


def test_quality_of_documents_held_out(spark):
    """Fitted on the labels of even ids, judged on those of odd ids: nearly all good ones stay and no bad one."""
    from cohortveil.llm.tables import table

    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels.where("doc_id % 2 = 0")).collect() if not r.base_failed}
    told = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good, bad = ([kept[i] for i, q in told.items() if q == want and i in kept] for want in (1, 0))
    assert len(good) > 100 and len(bad) > 5 and sum(good) >= 0.98 * len(good) and not any(bad)


def test_quality_ratio_by_hand(spark):
    """Words and pairs of words count in both multinomials, and nothing else where all words look alike."""
    import math

    rows = [(i, " ".join(("good", "word") * 6)) for i in range(4)] + [(10 + i, " ".join(("evil", "word") * 6)) for i in range(12)]
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    got = {r.doc_id: r.llr for r in quality.judge(frame(spark, rows), labels, smoothing=1e-9).collect()}
    n = 12 + 11 + 12 + 11 + 10  # grams of a document
    word, pair = math.log(6 / n) - math.log(6 * 16 / (16 * n)), math.log(4)
    assert got[0] == pytest.approx((6 * pair + 6 * word + 11 * pair) / n, abs=1e-3) and got[10] < -5


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((None, "a", "b", "b", "b", "c", "é", "zz")), rng.choice((0, 1, 5, 20, 200))) for i in range(900)] + [(1, "a", 5), (None, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("count", F.lit(0))
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute.mix_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 400
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in again) == sorted((r.doc_id or -1, r.size, r.copies) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.copies for r in mixing.mix(docs.withColumn("size", F.lit(0).cast("long"))).collect()} == {0}
