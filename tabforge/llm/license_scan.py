"""License scans by diagonal voting.

Every template is a sequence of words: a phrase, which must stand whole, or a
notice, of which a share is enough.  All rolling word k-grams of all documents
(k words, fewer for a template that is shorter) are hashed and joined with the
templates' positions.  A gram at word p of a document and word t of a template
votes for the diagonal p - t.  Votes are gathered by (document, template,
diagonal); diagonals that lie at most ``slack`` words apart are merged, which
bridges inserted and dropped words; and each span so found is verified: the
distinct template words that its grams cover must reach the template's share.
Grams are compared word by word in the join, so a vote never rests on a hash
alone, and a phrase (no slack, all of its words) is found exactly where its
words stand consecutively.

DataFrame functions only.  One pass over the documents: the join keeps the
votes, and one row a document whether it has votes or not; both are written
together, which pins the row numbers.  Votes are few, so what is shuffled is
one narrow row a document.  The templates are a parameter: their grams are
broadcast only below ``BROADCAST_GRAMS``, beyond it the grams meet in a
shuffle.  A document with very many votes is bounded by its own length and
sorted on disk, never collected: what is gathered per span is at most the
template's positions.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  Null text, empty text or no words: no votes, counts 0, labels
empty, score 0.  Repeated rows and equal or null ids are rows of their own.
An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

K = 4                       # words of a gram; a shorter template: 2
SHORT_K = 2
SLACK_PERCENT = 10          # of a notice's words: diagonals so far apart merge
NEED_PERCENT = 60           # of a notice's words must be covered
BROADCAST_GRAMS = 100_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """``need`` is the percentage of the words that a span must cover; a
    phrase needs all of them on one diagonal."""
    label: str
    text: str
    base: bool = False
    need: int = 100

    @property
    def words(self) -> list[str]:
        import re
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in self.text)
        return [w for w in re.split(SEPARATORS, low) if w]

    @property
    def k(self) -> int:
        return SHORT_K if self.need == 100 else K

    @property
    def slack(self) -> int:
        return 0 if self.need == 100 else len(self.words) * SLACK_PERCENT // 100


# The phrases of the query.
BASE = [Template("mit", "mit license", True), Template("apache", "apache license", True),
        Template("gpl", "general public license", True)]

# Further phrases.
PHRASES = [Template(a, b) for a, b in (
    ("agpl", "affero general public license"), ("lgpl", "lesser general public license"),
    ("mpl", "mozilla public license"), ("bsd", "bsd license"), ("isc", "isc license"),
    ("epl", "eclipse public license"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"), ("cc-by-nd", "cc by nd"), ("cc0", "cc0 1 0"),
    ("cc-by", "creative commons attribution"), ("proprietary", "all rights reserved"))]

# Notices that public licences ask their users to copy.
NOTICES = [Template(a, b, need=NEED_PERCENT) for a, b in (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
     and associated documentation files (the "Software"), to deal in the Software without restriction, including
     without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
     of the Software, and to permit persons to whom the Software is furnished to do so"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
     in compliance with the License. You may obtain a copy of the License at"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or
     (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
     provided that the following conditions are met: Redistributions of source code must retain the above copyright
     notice, this list of conditions and the following disclaimer."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
     is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
     MPL was not distributed with this file, You can obtain one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
     modify, publish, use, compile, sell, or distribute this software"""),
    ("gfdl", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free
     Documentation License"""))]

TEMPLATES = BASE + PHRASES + NOTICES


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words[:k])


def template_grams(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, int]:
    """All rolling grams of the templates, one row a position, and their
    number: gram, t1 to tK (null beyond the gram's words), template, t, and
    the template's k, n_template, slack, need, label and base."""
    rows = []
    for i, tpl in enumerate(templates):
        words, k = tpl.words, tpl.k
        if len(words) < k:
            raise ValueError(f"template {tpl.label!r} has fewer than {k} words")
        rows += [(i, t, k, len(words), tpl.slack, tpl.need, tpl.label, tpl.base,
                  *(words[t:t + k] + [None] * (K - k))) for t in range(len(words) - k + 1)]
    names = [f"t{j}" for j in range(1, K + 1)]
    df = spark.createDataFrame(rows, "template int, t int, k int, n_template int, slack int, need int, label string, "
                               "base boolean, " + ", ".join(f"{n} string" for n in names))
    cols = [F.col(n) for n in names]
    return df.withColumn("gram", F.when(F.col("k") == K, _gram(K, cols)).otherwise(_gram(SHORT_K, cols))), len(rows)


def votes(docs: DataFrame, templates: list[Template], scratch: Scratch, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Written table of votes (row, id, n_words, p and the template's columns)
    and of one row a document without a template."""
    grams, n_grams = template_grams(docs.sparkSession, templates)
    worded = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).withColumn(
        "row", F.monotonically_increasing_id())
    shifted = [F.col("words"), *(F.slice("words", i, F.size("words")) for i in range(2, K + 1))]
    spread = worded.select("row", "id", F.size("words").alias("n_words"),
                           F.posexplode_outer(F.arrays_zip(*shifted)).alias("p", "g"))
    ws = [F.col("g")[str(i)] if i else F.col("g")["words"] for i in range(K)]
    ks = sorted({tpl.k for tpl in templates})
    spread = spread.select("row", "id", "n_words", "p", *(w.alias(f"w{i + 1}") for i, w in enumerate(ws)))
    cols = [F.col(f"w{i + 1}") for i in range(K)]
    hashed = spread.select("*", F.posexplode(F.array(*(_gram(k, cols) for k in ks))).alias("which", "h"))
    same = F.col("h") == F.col("gram")
    for i in range(1, K + 1):
        same = same & (F.col(f"t{i}").isNull() | (F.col(f"t{i}") == F.col(f"w{i}")))
    side = F.broadcast(grams) if n_grams <= BROADCAST_GRAMS else grams
    own = (F.coalesce("p", F.lit(0)) == 0) & (F.col("which") == 0)
    found = hashed.join(side, same, "left").where(F.col("template").isNotNull() | own)
    return scratch.write(found.select(
        "row", "id", "n_words", "p", "template", "t", "k", "n_template", "slack", "need", "label", "base"), "votes")


def spans(cast: DataFrame) -> DataFrame:
    """Verified spans of the votes: row, id, template, label, base, first_word,
    n_span (words), covered (of the template's words), share."""
    order = Window.partitionBy("row", "template").orderBy("diagonal", "p")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    runs = cast.where(F.col("template").isNotNull()).withColumn("diagonal", F.col("p") - F.col("t")).withColumn(
        "new", F.when(step <= F.col("slack"), 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "template", "run", "id", "k", "n_template", "need", "label", "base").agg(
        F.min("p").alias("first_word"), (F.max(F.col("p") + F.col("k")) - F.min("p")).alias("n_span"),
        F.collect_set("t").alias("ts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    return merged.withColumn("covered", covered).where(
        F.col("covered") * 100 >= F.col("need") * F.col("n_template")).select(
        "row", "id", "template", "label", "base", "first_word", "n_span", "covered",
        (F.col("covered") / F.col("n_template")).alias("share"))


def find_licenses(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """All verified spans of all documents, see :func:`spans`; ``row`` numbers
    the documents of this call."""
    scratch = Scratch(docs.sparkSession, "license_scan")
    return spans(votes(docs, templates or TEMPLATES, scratch, id_col, text_col))


def scan_documents(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base (all places of base phrases),
    first_word and last_word (smallest and largest start of these; null
    without any), base_labels and labels (distinct, sorted, comma-joined;
    empty without any), score (largest verified share of a template, 0
    without any)."""
    scratch = Scratch(docs.sparkSession, "license_scan")
    cast = votes(docs, templates or TEMPLATES, scratch, id_col, text_col)
    none = lambda kind: F.lit(None).cast(kind)
    own = cast.where((F.coalesce("p", F.lit(0)) == 0)).select(
        "row", "id", "n_words", none("string").alias("label"), none("boolean").alias("base"),
        none("int").alias("first_word"), none("double").alias("share"))
    every = own.unionByName(spans(cast).select(
        "row", "id", none("int").alias("n_words"), "label", "base", "first_word", "share"))
    at_base = F.when(F.col("base"), F.col("first_word")).cast("long")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return every.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("n_words").cast("long").alias("n_words"),
        F.count(at_base).alias("n_base"), F.min(at_base).alias("first_word"), F.max(at_base).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score")).drop("row")
