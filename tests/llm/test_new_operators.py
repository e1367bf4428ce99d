"""Token alignment, license scans, spelling variants; and the queries' SQL."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortveil.llm import license_scan, mixing, queries, spelling, token_align, url_filter

SF = "/root/testdata/sf0.001"
FILES = (f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model")
needs_files = pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="the tokenizers' files aren't here")

TEXTS = [
    None, "", "abé \U0001F600 日本語 text  x\n\n\ty <|endoftext|> </s>", "a" * 9000 + " " * 9000 + "zq" * 5000, "ﬁ ½ Å   x\x00y", " lead", "tra  il ", "twice twice", "twice twice",
    "The cat sat on the mat, and the cat's hat. 12,345.67", "Überraschung große Straße",
]


def spelled_by(text, encode, bytes_of):
    return [(i, bytes_of(i)) for i in encode(text)]


def groups_of(text, a, b):
    """Lists of (A ids, B ids) cut where both end, by walking along the bytes."""
    if not text:
        return []
    left, right, wanted = a(" " + text), b(text), (" " + text).encode()
    if b"".join(x for _, x in left) != wanted or b"".join(x for _, x in right) != wanted:
        return []
    out, own, ends = [], ([], []), [0, 0]
    queue = [list(left), list(right)]
    while queue[0] or queue[1]:
        side = 0 if queue[0] and (ends[0] <= ends[1] or not queue[1]) else 1
        i, spelled = queue[side].pop(0)
        own[side].append(i)
        ends[side] += len(spelled)
        if ends[0] == ends[1]:
            out.append(own)
            own = ([], [])
    return out


@needs_files
@pytest.mark.parametrize("head", [token_align.HEAD, 7, 0])
def test_alignment_against_walking_along(spark, head):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole, pieces, byte = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1]), token_align._byte_of_char()
    whole.encode_special_tokens = True
    a = lambda t: [(i, bytes(byte[c] for c in whole.id_to_token(i))) for i in whole.encode(t, add_special_tokens=False).ids]
    b = lambda t: [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(t)]
    rows = [(n % 9, t) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "times": F.lit(2), "pairs": F.lit("x")}).repartition(3)
    got = token_align.align(docs, *FILES, head=head).collect()
    found = [(i, groups_of(t, a, b)) for i, t in rows]
    count, best = Counter(), defaultdict(int)
    for _, groups in found:
        count.update({(x, y) for left, right in groups for x in set(left) for y in set(right)})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = []
    for i, groups in found:
        links = [(x, y) for left, right in groups if len(left) * len(right) < 10_000 for x in left for y in right]
        links += [(x, y) for left, right in groups if len(left) * len(right) >= 10_000 for x in left for y in right]
        want.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)))
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[1] > 0 for w in want) >= 7
    assert token_align.align(docs.limit(0), *FILES).count() == 0


@needs_files
def test_large_groups_count_equal_ids_together():
    import numpy as np

    ids = [np.array([5, 6] * 60), np.array([9] * 80)]
    _, pairs, counts = token_align._linked(ids[0], ids[1], np.zeros(120, np.int64), np.zeros(80, np.int64), np.array([120]), np.array([80]), 100)
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == {509: 4800, 609: 4800}


def test_license_scan_cases(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    cases = [
        (1, None, "", "", 0.0), (2, "", "", "", 0.0), (3, filler, "", "", 0.0),
        (4, filler + "Licensed under the Apache License, Version 2.0", "", "apache-2.0", 1.0),
        (5, "This work is licensed under the GNU General Public License, version 3. " + filler, "gpl", "gpl,gpl-3.0", 1.0),
        (6, "Licensed under CC BY-SA 4.0.", "cc-by", "cc-by,cc-by-sa-4.0", 1.0), (7, "Licensed under CC BY 4.0.", "cc-by", "cc-by,cc-by-4.0", 1.0),
        (8, "ALL RIGHTS\n RESERVED all Rights reserved", "reserved", "reserved", 0.0), (9, "allrights reserved, liKense Kcc by", "", "", 0.0),
        (10, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of\nthis software and associated documentation files (the", "", "mit", 1.0),
        (11, filler * 200 + "Released under the MIT License " + filler * 200, "", "mit", 1.0),
        (6, "Licensed under CC BY-SA 4.0.", "cc-by", "cc-by,cc-by-sa-4.0", 1.0),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in cases], "doc_id long, text string").withColumns({"key": F.lit(1), "block": F.lit(2), "words": F.lit(3), "label": F.lit("x")})
    got = license_scan.scan(docs).collect()
    assert sorted((r.doc_id, r.base_labels, r.labels, r.score) for r in got) == sorted((i, b, m, s) for i, _, b, m, s in cases)
    (both,) = [r for r in got if r.doc_id == 8]
    assert (both.n_words, both.n_base, both.first_word, both.last_word) == (6, 2, 0, 3)
    (found,) = [r.found for r in got if r.doc_id == 4]
    assert all(f.label == "apache-2.0" and 200 - 48 < f.start <= 200 for f in found)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_words_are_split_not_extracted(spark):
    """Words are those of the pattern whatever stands around them, and no plan extracts them one match at a time."""
    texts = ["", " ", "...", "\x00a\x00", "a", "-a--b-", "cc\tby", "\u00e9\ud7ff-\U0001f600x", "a" * 3000 + "\n", "0:9@a[z`b{c\x7fd"]
    docs = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "doc_id long, text string")
    got = docs.select("doc_id", license_scan.words_of("text").alias("own"), F.regexp_extract_all("text", F.lit(license_scan.PLAIN), F.lit(0)).alias("want")).collect()
    assert [r.own for r in got] == [r.want for r in got]
    assert "regexp_extract_all" not in license_scan.scan(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_license_scan_finds_every_block_over_the_share(spark):
    """Random texts over few words against trying each block with each piece."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.sample(words, rng.randrange(2, 9)))) for k in range(6)]
    texts = [" ".join(rng.choice([*words, "x", "y"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").select("key", F.split("text", " ").alias("words"))
    for share, width in ((0.5, 6), (0.8, 8), (1.0, 9)):
        got = {(r.key, r.block, r.piece, r.held) for r in license_scan.matches(docs, templates, share, width).collect()}
        want = set()
        for key, text in enumerate(texts):
            told = text.split(" ")
            for block in range(0, -(-len(told) // width)):
                own = set(told[block * width : (block + 2) * width])
                want |= {(key, block, n, len(own & set(piece))) for n, _, piece in license_scan._pieces(templates, width) if len(own & set(piece)) >= len(set(piece)) * share - 1e-9}
        assert got == want and want


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [spelling.MOST, 12])
def test_spelling_variants_against_all_pairs(spark, most):
    """Also where halves that more than twelve words share are dealt again by quarters and eighths."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(2, 8))) for _ in range(250)} | {"prefix" + "".join(rng.choice("xyz") for _ in range(6)) for _ in range(120)} | {"x" * 400, "x" * 399}
    n = {w: rng.choice([2, 3, 20, 30, 400, 5000]) for w in words}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most).collect()}
    form = {}
    for w in words:
        own = [x for x in words if x != w and near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n[w], len(own), form[w], n[form[w]] if form[w] else None), w
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        assert got[w].root == root
    assert sum(f is not None for f in form.values()) > 20
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("ab", 1)], "word string, n long"), ratio=1)


def test_counted_words(spark):
    rows = [(1, "Straße STRASSEN-bahnhof éclairs"), (1, "Straße STRASSEN-bahnhof éclairs"), (None, "bahnhof Éclairs"), (2, None), (3, ""), (4, "short " * 50)] + [(10 + i, "wonderful") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "id": F.lit("x")})
    got = {r.word: r.n for r in spelling.counted_words(docs).collect()}
    import re

    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            small = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{small}".encode())
            at = h % len(small)
            want[small[:at] + small[at + 1 :] if h % 31 == 0 else small] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert len(got) > 3 and spelling.variants(spelling.counted_words(docs.limit(0))).count() == 0
    assert {r.word for r in spelling.counted_words(docs, slip_every=0).collect()} == {"strassen", "bahnhof", "éclairs", "wonderful"}


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", 3, "k", "s", 7, 8)], "doc_id long, source string, size long, _key string, _slice string, _before int, _nth int")
    (row,) = mixing.mix(docs).collect()
    assert (row["_key"], row["_slice"], row["_before"], row["_nth"]) == ("k", "s", 7, 8)
    pages = spark.createDataFrame([(1, "http://a.com/casino/x", "u", "r", "v")], "page_id long, url string, _url string, _rule string, _verdict string")
    (row,) = url_filter.judge(pages, queries.DOMAIN_RULES).collect()
    assert (row["_url"], row["_rule"], row["_verdict"], row["verdict"]) == ("u", "r", "v", "block")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    want = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str) == want
