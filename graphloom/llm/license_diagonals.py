"""License scans by diagonal voting. DataFrame functions only.

All rolling word pairs of a text are hashed and joined to the templates' pairs. A hit votes for the diagonal (place in the
text - place in the template) on which template and text run side by side; the words themselves are compared at every
hit, so votes hold no hash collisions. Neighbouring diagonals, between which words were put in or left out, are merged
where text and template both go on; a merged span thus shows every place of its template once and in order, and counts
if it covers enough of them in about the template's length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that are found wherever their words stand one after the other, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wording of licences and of their notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
#: Votes that a diagonal of a long template needs to be looked at, how far merged diagonals may lie apart, and the share
#: of a template's pairs that a span must show: all of them in a template of fewer than SHORT.
LEAST_VOTES, DRIFT, COVER, SHORT = 3, 4, 0.6, 10
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, text.lower()) if w]


def template_pairs(spark: SparkSession, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """(h, w1, w2, template, label, is_base, length, at): one row a word pair of each template."""
    rows = []
    for base, (label, text) in [*((True, (v, k)) for k, v in phrases.items()), *((False, t) for t in templates)]:
        words = words_of(text)
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        rows += [(w1, w2, f"{label}:{text[:40]}", label, base, len(words) - 1, i) for i, (w1, w2) in enumerate(zip(words, words[1:]))]
    made = spark.createDataFrame(rows, "w1 string, w2 string, template string, label string, is_base boolean, length int, at int")
    return made.withColumn("h", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts the places of all phrases; first_word and last_word are the smallest and largest of their first words.
    labels adds those of templates found; score is the best share of a template's places found, 1 for a phrase. Null and empty texts have no
    words and no labels. Rows are told apart by a number of their own, so repeated rows and null ids are reported each.
    Other columns are ignored; an empty table gives no rows.
    """
    # two characters that lower() would turn into ASCII letters stay what they are
    text = F.lower(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(text, WORD_GAP), "").alias("words"))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("hashes", F.expr("CASE WHEN n_words > 1 THEN transform(slice(words, 1, cast(n_words - 1 AS int)), (w, i) -> xxhash64(w, words[i + 1])) END"))
    df = df.select("row", "doc_id", "n_words", "words", F.posexplode_outer("hashes").alias("pos", "hash"))
    # the templates are a fixed list of a few hundred pairs
    t = F.broadcast(template_pairs(docs.sparkSession, phrases, templates))
    hit = (F.col("hash") == F.col("h")) & (F.get("words", "pos") == F.col("w1")) & (F.get("words", F.col("pos") + 1) == F.col("w2"))
    hits = df.join(t, hit, "left").where("template IS NOT NULL OR coalesce(pos, 0) = 0")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("h").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    # diagonals with too few votes stay as rows without a template, so that every document keeps a row
    enough = F.when(F.col("is_base"), F.col("votes") == F.col("length")).otherwise(F.col("votes") >= F.least(F.lit(LEAST_VOTES), "length"))
    votes = votes.withColumns({c: F.when(enough, F.col(c)) for c in ("template", "label", "is_base", "length", "diagonal")})
    # a phrase's place is one diagonal; a longer template's neighbouring diagonals become one span as long as each begins
    # behind the one before, in the text and in the template
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce("is_base", F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT)
    votes = votes.withColumn("near", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    along = Window.partitionBy("row", "template", "near").orderBy("lo", "diagonal")
    back = (F.col("lo") <= F.lag("hi").over(along)) | (F.col("lo") - F.col("diagonal") <= F.lag(F.col("hi") - F.col("diagonal")).over(along))
    votes = votes.withColumn("span", F.sum(F.when(F.coalesce(back, F.lit(True)), 1).otherwise(0)).over(along))
    spans = votes.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "length", "near", "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("first"))
    cover = F.col("votes") / F.col("length")
    good = F.col("is_base") | ((cover >= F.when(F.col("length") < SHORT, 1.0).otherwise(COVER)) & (F.col("hi") - F.col("lo") + 1 <= 2 * F.col("length")))
    spans = spans.withColumn("cover", F.when(good, cover)).withColumn("base_at", F.when(F.col("is_base"), F.col("first").cast("long")))
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count("base_at").alias("n_base"), F.min("base_at").alias("first_word"), F.max("base_at").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("cover").isNotNull(), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
