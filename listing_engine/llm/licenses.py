"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-grams of a text's words are joined with the places of the same
k-grams in license templates. Each match votes for a diagonal (place in the
text minus place in the template); neighbouring diagonals are merged, so an
inserted or dropped word doesn't split a license, and a span counts if enough
of the template's k-grams stand in it. Base phrases are templates, too, whose
words must all stand consecutively.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listing_engine.llm.shared import lower_ascii, table

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Well-known license sentences and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("all rights reserved", "all-rights-reserved"),
)
GRAM = 2
#: Diagonals that may lie between neighbours of one span.
SLACK = 3
#: Share of a template's k-grams that a span needs.
COVERAGE = 0.7


def words_of(text: Column) -> Column:
    """A-Z lower-cased; words are runs of digits, a-z and everything beyond ASCII; null: none."""
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(split, "")


def template_places(spark: SparkSession, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, label, exact, words, place and hash of each k-gram: a table of fixed, small size.

    Base phrases have one k-gram, their first; their further words are compared as they are.
    """
    rows = []
    for number, (phrase, label, exact) in enumerate([(*b, True) for b in base] + [(*t, False) for t in templates]):
        words = phrase.split()
        for place in range(1 if exact else len(words) - GRAM + 1):
            rows.append((number, label, exact, words, place, words[place], words[place + 1], len(words) - GRAM + 1))
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, words array<string>, place int, w0 string, w1 string, n_grams int")
    return df.select("template", "label", "exact", F.col("words").alias("phrase"), F.col("place").alias("t_place"), "n_grams", F.xxhash64("w0", "w1").alias("gram"))


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each (doc_id, text) of `docs`.

    Null and empty texts have no words and no labels. Rows of equal doc_id and
    text give one result, further columns are ignored. score is the best
    coverage of a template (1 for a base phrase, 0 without a label).
    """
    # the templates are constants of this module (or a caller's list on the driver): a bounded side
    places = F.broadcast(template_places(docs.sparkSession, base, templates))
    texts = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("text_hash"), words_of(F.col("text")).alias("words"))
    # one row for each place, and one for the text itself (place -1)
    grams = texts.select(
        "doc_id", "text_hash", "words", F.size("words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - GRAM, F.lit(-1)))).alias("place")
    ).withColumn("gram", F.when(F.col("place") >= 0, F.xxhash64(F.get("words", F.col("place")), F.get("words", F.col("place") + 1))))
    joined = grams.join(places, "gram", "left").filter(
        "place = -1 or template is not null and (not exact or slice(words, place + 1, size(phrase)) = phrase)"
    )
    own = ["doc_id", "text_hash"]
    votes = joined.groupBy(*own, "template", "label", "exact", "n_grams", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(
        F.collect_set("t_place").alias("grams"), F.max("n_words").alias("n_words")
    )
    # neighbouring diagonals of one text and template; diagonals far apart start a new span
    along = Window.partitionBy(*own, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > SLACK
    merged = (
        votes.withColumn("new", F.coalesce(apart | F.col("exact"), F.lit(False)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy(*own, "template", "label", "exact", "n_grams", "span")
        .agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("n_found"), F.max("n_words").alias("n_words"))
    )
    coverage = F.col("n_found") / F.col("n_grams")
    spans = merged.withColumns({"share": F.when(F.col("exact"), 1.0).when(coverage >= COVERAGE, coverage), "is_base": F.coalesce("exact", F.lit(False))})
    base_start = F.when(F.col("is_base"), F.col("start"))
    labels = F.array_join(F.array_sort(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label")))), ",")
    return spans.groupBy(*own).agg(
        F.max("n_words").alias("n_words"),
        F.count(base_start).alias("n_base"),
        F.min(base_start).cast("long").alias("first_word"),
        F.max(base_start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        labels.alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op5_licenses": op5_licenses}
ORACLE: dict[str, str] = {}
