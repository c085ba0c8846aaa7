"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of a document is joined with the positions that it has in the templates (k = 3; a template of
two words has one gram of two). A match votes for the diagonal (place in the text less place in the template); votes
are counted by document, template and diagonal, neighbouring diagonals are merged, since a changed word shifts or thins
them, and a span is kept if its voted words cover enough of the template. Each vote compares the words themselves.

Defined results: a null text counts as empty and has no words; repeated rows each get a row (a vote counts once for each
template position); templates need two words at least; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.llm.common import NON_WORD, ascii_lower
from wayfinder.shared import materialize

#: The base phrases and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by which common licences are declared, with the labels that the method adds.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Share of a template's words that voted places must cover, largest step between neighbouring diagonals.
COVER, STEP = 0.75, 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def _templates(spark: SparkSession, phrases, base: bool) -> list[tuple]:
    rows = []
    for name, (phrase, label) in enumerate(phrases):
        w = phrase.split()
        if len(w) < 2:
            raise ValueError(f"a template needs two words: {phrase!r}")
        grams = [(0, w[0], w[1], None)] if len(w) == 2 else [(i, w[i], w[i + 1], w[i + 2]) for i in range(len(w) - 2)]
        rows += [(("b" if base else "m") + str(name), label, len(w), len(grams), *g) for g in grams]
    return rows


def scan_licenses(docs: DataFrame, base=BASE_PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER, step: int = STEP) -> DataFrame:
    """One row per document: words, places and ends of base phrases, labels, score, and spans of the notices (template label, first word, end word, cover)."""
    spark = docs.sparkSession
    # as large as the caller's templates, whatever the documents: fit to be broadcast
    grams = spark.createDataFrame(_templates(spark, base, True) + _templates(spark, notices, False), "template string, label string, t_words int, t_grams int, pos int, t1 string, t2 string, t3 string").withColumn("h", F.xxhash64("t1", "t2"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    placed = rows.select("doc_id", "text_hash", "words", F.posexplode("words").alias("i", "w1"))
    two, three = F.get("words", F.col("i") + 1), F.get("words", F.col("i") + 2)
    rolling = placed.select("doc_id", "text_hash", "i", "w1", two.alias("w2"), three.alias("w3"), F.xxhash64("w1", two).alias("h"))
    same = (rolling["h"] == grams["h"]) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("t3").isNull() | (F.col("w3") == F.col("t3")))
    votes = rolling.join(F.broadcast(grams), same).groupBy("doc_id", "text_hash", "template", "label", "t_words", "t_grams", (F.col("i") - F.col("pos")).alias("diagonal")).agg(F.collect_set("pos").alias("places"))
    votes = materialize(votes, "votes")  # read twice below; texts are cut into words and joined once

    exact = votes.where("template like 'b%' and size(places) = t_grams")
    by_place = Window.partitionBy("doc_id", "text_hash", "template").orderBy(F.col("diagonal") + F.array_min("places"), "diagonal")
    begin, end = F.col("diagonal") + F.array_min("places"), F.col("diagonal") + F.array_max("places") + F.least(F.col("t_words"), F.lit(3))
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by_place)) > step) | (begin > F.lag(end).over(by_place) + step)
    merged = (
        votes.where("template like 'm%'")
        .withColumns({"begin": begin, "end": end, "new": F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)})
        .withColumn("run", F.sum("new").over(by_place))
        .groupBy("doc_id", "text_hash", "template", "label", "t_words", "run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        .withColumn("cover", F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + 2))))) / F.col("t_words"))
        .where((F.col("cover") >= cover) & (F.col("end") - F.col("begin") <= 2 * F.col("t_words")))
    )
    found = exact.select("doc_id", "text_hash", "label", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), F.lit(1.0).alias("cover")).unionByName(
        merged.select("doc_id", "text_hash", "label", F.lit(False).alias("base"), F.col("begin").cast("long"), F.col("end").cast("long"), F.least(F.col("cover"), F.lit(1.0)).alias("cover"))
    )
    per_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("begin"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("begin"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(~F.col("base"), F.struct("label", "begin", "end", "cover")))).alias("spans"),
    )
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    return counted.join(per_doc, counted["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
