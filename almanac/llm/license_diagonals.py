"""Licence scans by diagonal voting (operator 6).

All rolling word ``K``-grams of every document are joined by hash to their
positions in the licence templates. A match votes for its diagonal, the offset
between document and template position; votes are aggregated by (document,
template, diagonal), neighbouring diagonals are merged into spans, and spans are
verified word by word: a vote counts only if its words equal the template's, and
a span needs ``MIN_COVER`` of the template's words. Only DataFrame functions.

Joins: the templates are a fixed list (their k-grams number less than
``MAX_GRAMS``, checked), so that side is broadcast and the k-grams of the texts
are never shuffled; only votes are. Votes of one document and diagonal combine
before the shuffle, so a phrase in a third of all documents stays spread over
them.

Edge cases: a null or empty text has no words, no places and empty labels;
repeated rows get the same result each, null ids too; a text shorter than ``K``
words has no k-gram but still its base phrases; an empty table gives an empty
result; other columns are left out of the result and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, read

K = 3
NEAR = 4                 # diagonals at most this far apart (inserted or left out words) merge
MIN_COVER = 0.6
MAX_GRAMS = 20_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
           ("cc by", "cc-by"), ("mit license", "mit"))
# Notices as licences ask to have them worded, with the method's labels.
TEMPLATES = (
    ("mit-notice", "released under the MIT License"),
    ("mit-notice", "licensed under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a "
     "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("rights-reserved", "All rights reserved"),
)


def license_words(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as an array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Hash of the K words from each position on."""
    return F.when(F.size(words) >= K, F.transform(
        F.sequence(F.lit(0), F.size(words) - K),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(hash, label, template, t_words, t_pos, gram) of all template positions."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                 "template int, t_label string, text string")
    out = (rows.withColumn("w", license_words(F.col("text")))
           .select("template", "t_label", F.size("w").alias("t_words"), "w",
                   F.posexplode(grams_of(F.col("w"))).alias("t_pos", "hash"))
           .withColumn("gram", F.slice("w", F.col("t_pos") + 1, K)).drop("w"))
    if (n := out.count()) > MAX_GRAMS:
        raise ValueError(f"{n} template k-grams; {MAX_GRAMS} may be broadcast")
    return out


def license_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, first_word, last_word, cover) of merged diagonals.

    ``docs`` has doc_id and text. All spans are given, with the share of the
    template's words that stand in them; ``last_word`` is exclusive.
    """
    spark = docs.sparkSession
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("w"))
    exploded = worded.select("doc_id", "text_hash", "w", F.posexplode(grams_of(F.col("w"))).alias("pos", "hash"))
    votes = (exploded.join(F.broadcast(template_grams(spark, templates)), "hash")
             .where(F.slice("w", F.col("pos") + 1, K) == F.col("gram"))
             .select("doc_id", "text_hash", "t_label", "template", "t_words", "t_pos",
                     (F.col("pos") - F.col("t_pos")).alias("diagonal")))
    keys = ["doc_id", "text_hash", "template", "t_label", "t_words"]
    # A set per diagonal has at most the template's positions in it.
    diagonals = votes.groupBy(*keys, "diagonal").agg(F.collect_set("t_pos").alias("at"))
    of = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > NEAR, F.lit(True))
    merged = (diagonals.withColumn("span", F.sum(apart.cast("int")).over(of))
              .select(*keys, "span", "diagonal", F.explode("at").alias("t_pos"))
              .groupBy(*keys, "span").agg(
                  F.min(F.col("diagonal") + F.col("t_pos")).alias("first_word"),
                  F.max(F.col("diagonal") + F.col("t_pos") + K).alias("last_word"),
                  F.collect_set("t_pos").alias("at")))
    # Template words within any matched k-gram.
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "at", lambda p: F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda j: p + j)))))
    return merged.select("doc_id", "text_hash", F.col("t_label").alias("label"), "first_word", "last_word",
                         (covered / F.col("t_words")).alias("cover"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split(" ")

    def stands(i):
        out = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(words, i + j) == p, F.lit(False))
        return out

    return F.filter(F.transform(words, lambda w, i: F.when(stands(i), i)), lambda i: i.isNotNull())


def scan_licenses(docs: DataFrame, templates=TEMPLATES, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: words, base places, labels and the best cover."""
    spans = license_spans(docs, templates)
    method = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("cover") >= min_cover, F.col("label"))).alias("found"),
        F.max("cover").alias("cover"))
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("w"))
    for phrase, label in PHRASES:
        worded = worded.withColumn(f"at_{label}", phrase_places(F.col("w"), phrase))
    places = F.concat(*[F.col(f"at_{label}") for _, label in PHRASES])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for _, x in PHRASES]))
    base = worded.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels.alias("base_labels"))
    same = F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_hash") == F.col("m.text_hash"))
    both = base.alias("b").join(method.alias("m"), same, "left")
    every = F.array_union("b.base_labels", F.coalesce("m.found", F.array().cast("array<string>")))
    return both.select(
        "b.doc_id", "b.n_words", "b.n_base", "b.first_word", "b.last_word",
        F.array_join(F.array_sort("b.base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("m.cover", F.lit(0.0))).alias("score"))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))
