"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A template is cut into pieces of at most ``WIDTH`` words; a text into blocks of
twice as many, one every ``WIDTH`` words, so a piece that stands in a text lies
whole in one block.  A block meets a piece if it holds the given share of its
distinct words.  Words of templates are ordered by how often all documents hold
them, rarest first; of a piece only so many first words (its prefix) are looked
for that a block without them can't reach the share, and a pair is dropped by
length (the block's words are too few) and by place (too few words are left
behind the shared one on either side) before whole sets are compared.  No pair
that reaches the share is lost, and texts without any prefix word are never cut.

Texts are lower-cased in A-Z only.  A null or empty text has no words.  Equal
rows share one result, rows of equal texts and different ids have one each.
Columns besides id and text aren't read.  Blocks of a long text are dealt out
like any others; a block has at most ``2 * WIDTH`` words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, SHARE = 24, 0.85

# Phrases whose words stand consecutively, and the labels they give.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices by which licenses are told, as their authors word them.
TEMPLATES = (
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """The text with A-Z in small letters, as far as words of ASCII letters go: the one other character that has such a small letter is put away first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ķ")))


def words_of(low: Column) -> Column:
    """The words of a lowered text.  Splitting at what lies between them costs about a seventh of extracting them."""
    return F.array_remove(F.split(low, _GAP), "")


def _pieces(templates: Sequence[tuple[str, str]], width: int) -> list[tuple[int, str, list[str]]]:
    """Number, label and words of each template's pieces of about equal length."""
    out = []
    for label, text in templates:
        words = re.findall(PLAIN, text.lower())
        count = -(-len(words) // width)
        out += [(label, words[len(words) * k // count : len(words) * (k + 1) // count]) for k in range(count)]
    return [(n, label, words) for n, (label, words) in enumerate(out)]


def _literals(spark, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small table of the caller's own values, made in the JVM."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))))


def needed(size: Column, share: float) -> Column:
    """How many of so many words make the share."""
    return F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int")


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places from 0 where the phrase's words stand one after the other."""
    fits = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def here(i: Column) -> Column:
        first, *rest = fits(i)
        for one in rest:
            first = first & one
        return first

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def phrases(docs: DataFrame, known: Sequence[tuple[str, str]] = PHRASES, words: str = "words", low: str = "low") -> DataFrame:
    """``docs`` (with a text's words and its lowered form) with n_base, first_word, last_word and base_found (distinct labels, sorted)."""
    out, places = docs, []
    for n, (phrase, label) in enumerate(known):
        told = phrase.split(" ")
        seen = F.col(low).rlike(f"(?:^|{_GAP}){_GAP.join(told)}(?:$|{_GAP})")
        for word in told:  # far cheaper, and most texts lack one
            seen = F.contains(F.col(low), F.lit(word)) & seen
        out = out.withColumn(f"_at{n}", F.when(seen, _starts(F.col(words), told)).otherwise(F.array().cast("array<int>")))
        places.append((f"_at{n}", label))
    every = F.concat(*(name for name, _ in places))
    labels = F.array_sort(F.array_distinct(F.concat(*(F.when(F.size(name) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for name, label in places))))
    out = out.withColumns({"n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"), "base_found": labels})
    return out.drop(*(name for name, _ in places))


def matches(keyed: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """``key, block, label, piece, held, size`` of ``key, words``: every block and piece of a template of which it holds the share.

    ``block`` is the number of the block (from word ``block * width`` on), ``held``
    of ``size`` distinct words stand in it.
    """
    spark, pieces = keyed.sparkSession, _pieces(templates, width)
    told = _literals(spark, ("piece", "label", "token"), [(n, label, w) for n, label, words in pieces for w in dict.fromkeys(words)])
    vocabulary = sorted({w for _, _, words in pieces for w in words})
    count = keyed.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("token")).groupBy("token").count()
    ranked = told.select("token").distinct().join(count, "token", "left").select("token", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    order = [r.token for r in ranked.orderBy("count", "token").collect()]  # the templates' words, rarest first
    rank = F.create_map(*(F.lit(x) for pair in ((w, n) for n, w in enumerate(order)) for x in pair))

    own = told.withColumn("rank", rank[F.col("token")]).groupBy("piece", "label").agg(F.array_sort(F.collect_list("rank")).alias("set"))
    own = own.withColumn("size", F.size("set")).withColumn("least", needed(F.col("size"), share))
    prefix = own.select("piece", "label", "set", "size", "least", F.posexplode(F.slice("set", F.lit(1), F.col("size") - F.col("least") + 1)).alias("i", "rank"))
    first = [order[r.rank] for r in prefix.select("rank").distinct().collect()]  # prefix words, of the templates alone

    some = keyed.where(F.arrays_overlap("words", F.array(*map(F.lit, first))))
    hits = some.select("key", F.posexplode("words").alias("at", "token")).where(F.col("token").isin(vocabulary))
    nth = F.floor(F.col("at") / width).cast("int")
    placed = hits.select("key", F.explode(F.array(nth, nth - 1)).alias("block"), rank[F.col("token")].alias("rank")).where("block >= 0")
    blocks = placed.groupBy("key", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))  # at most 2 * width words each
    fewest = own.agg(F.min("least")).first()[0] or 1
    sized = blocks.withColumn("n", F.size("own")).where(F.col("n") >= fewest)
    asked = sized.select("key", "block", "own", "n", F.posexplode(F.slice("own", F.lit(1), F.col("n") - fewest + 1)).alias("j", "rank"))
    length, place = F.col("n") >= F.col("least"), F.col("j") <= F.col("n") - F.col("least")
    met = asked.join(F.broadcast(prefix), "rank").where(length & place)  # prefixes of the caller's own templates
    once = met.groupBy("key", "block", "piece", "label").agg(F.first("own").alias("own"), F.first("set").alias("set"), F.first("size").alias("size"), F.first("least").alias("least"))
    return once.withColumn("held", F.size(F.array_intersect("own", "set"))).where("held >= least").select("key", "block", "label", "piece", "held", "size")


def variants_of(templates: Sequence[tuple[str, str]], share: float, width: int) -> list[tuple[int, int]]:
    """Pairs (piece, other): of the caller's templates, those whose words the other one holds in the share, as of another version."""
    sets = [(n, set(words)) for n, _, words in _pieces(templates, width)]
    return [(n, m) for n, a in sets for m, b in sets if n != m and len(a & b) >= len(a) * share - 1e-9]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, known: Sequence[tuple[str, str]] = PHRASES, share: float = SHARE, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found``, one row for each row of ``docs``.

    Every piece that a block holds gives its label, unless the block or one that
    overlaps it holds more of another version of the piece (of equal shares the
    longer one, then the one with the least number).  ``score`` is the largest
    share, 0 without any; ``found`` lists (word where the block starts, label, share).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", lowered(F.col("text")).alias("low")).withColumn("words", words_of(F.col("low")))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("low")), 256)
    rows = rows.withColumn("key", key)
    told = F.struct((F.col("held") / F.col("size")).alias("share"), "size", (-F.col("piece")).alias("less"))
    met = checkpointed(matches(rows.select("key", "words"), templates, share, width).select("key", "block", "piece", "label", told.alias("told")))
    around = met.select("key", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("piece").alias("other"), F.col("told").alias("better"))
    pairs = _literals(docs.sparkSession, ("piece", "other"), variants_of(templates, share, width) or [(-1, -1)])
    beaten = met.join(around, ["key", "block"]).join(F.broadcast(pairs), ["piece", "other"]).where("better > told")  # pairs of the caller's own templates
    best = met.join(beaten.select("key", "block", "piece"), ["key", "block", "piece"], "left_anti")
    found = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((F.col("block") * width).cast("long").alias("start"), "label", "told.share"))).alias("found"), F.max("told.share").alias("score"))
    base = phrases(rows, known).select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_found")
    nothing = F.array().cast(found.schema["found"].dataType)
    joined = base.join(found, "key", "left").withColumn("found", F.coalesce("found", nothing))
    labels = F.array_sort(F.array_union("base_found", F.transform("found", lambda f: f["label"])))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "found")
