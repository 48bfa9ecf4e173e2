"""License scans by diagonal voting, DataFrame functions only.

Every two consecutive words of a text are hashed and joined to the places in the license templates that have the same
two words. A hit at word p of the text and place t of a template votes for the diagonal p - t: copies of a template
put their votes on one diagonal, edited copies on a few neighbouring ones. Votes are added up by diagonal, diagonals at
most `GAP` apart are merged, and a merged span holds its template's label if it covers enough of the template's places.
A phrase is a short template that has to be covered in full on one diagonal, so its hits are exact places.

Template hashes are a fixed small table (under 2,000 rows); only word pairs that occur in it leave a row.

Defined cases: a null or blank text has no words and no labels; rows with equal id and text give equal rows; long
texts are read whole; without any hit `first_word` and `last_word` are null, labels empty and the score 0; of
templates with equal votes each has its own spans and label, so ties need no choice; an empty table gives no rows; only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage

# Phrases of the base contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further short phrases of the method's own.
OWN_PHRASES = {"bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl",
               "lesser general public license": "lgpl", "affero general public license": "agpl",
               "eclipse public license": "epl", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
               "creative commons attribution": "cc-by"}
# The notices that these licenses ask to be kept.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
           "permit persons to whom the software is furnished to do so subject to the following conditions the above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
           "software",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at "
              "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
              "software distributed under the license is distributed on an as is basis without warranties or conditions "
              "of any kind either express or implied see the license for the specific language governing permissions and "
              "limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation either version 3 of the license or at your "
           "option any later version this program is distributed in the hope that it will be useful but without any "
           "warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met redistributions of source code must retain the above copyright notice this "
           "list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
           "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
           "materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
           "granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
           "not distributed with this file you can obtain one at http mozilla org mpl 2 0",
}
GAP = 3
COVER = 0.5
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, phrase, n_pairs, place, h): one row per word pair of every template."""
    rows = [(f"phrase {p}", x, p in BASE_PHRASES, True, p) for p, x in {**BASE_PHRASES, **OWN_PHRASES}.items()]
    rows += [(f"notice {x}", x, False, False, t) for x, t in NOTICES.items()]
    found = spark.createDataFrame(rows, "template string, label string, base boolean, phrase boolean, body string")
    pairs = found.withColumn("pairs", _pairs(F.split("body", " ")))
    return pairs.select("template", "label", "base", "phrase", F.size("pairs").alias("n_pairs"), F.posexplode("pairs").alias("place", "h"))


def candidates(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, and the places whose word pair is in some template; written once.

    Lower-casing leaves non-ASCII letters non-ASCII but for two capitals (Kelvin sign, dotted I) that are in no phrase.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.array_remove(
        F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), "").alias("words"))
    pairs = words.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), _pairs(F.col("words")).alias("pairs"))
    at = pairs.withColumn("at", F.array_compact(F.transform("pairs", lambda h, i: F.when(h.isin(hashes), i))))
    return cut_lineage(at.select("doc_id", "mark", "n_words", F.transform(
        "at", lambda i: F.struct(i.alias("p"), F.get("pairs", i).alias("h"))).alias("hits")))


def scan(docs: DataFrame, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): n_words of every row, and the verified and unverified spans.

    Spans: doc_id, mark, template, label, base, phrase, first, last (words), covered (share of the template).
    """
    spark = docs.sparkSession
    known = templates(spark)
    rows = candidates(docs, [r[0] for r in known.select("h").distinct().collect()])
    votes = rows.select("doc_id", "mark", F.explode("hits").alias("hit")).select("doc_id", "mark", "hit.p", "hit.h").join(
        F.broadcast(known), "h").withColumn("diagonal", F.col("p") - F.col("place"))
    place = ["doc_id", "mark", "template", "label", "base", "phrase", "n_pairs"]
    diagonals = votes.groupBy(*place, "diagonal").agg(F.collect_set("place").alias("places"))  # at most a template's length
    order = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    step = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), 1).otherwise(0)
    merged = diagonals.withColumn("step", step).withColumn("run", F.sum("step").over(order))
    spans = merged.groupBy(*place, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("places") + 1).alias("last"))
    covered = F.size("places") / F.col("n_pairs")
    needed = F.when(F.col("phrase"), 1.0).otherwise(cover)
    return rows.drop("hits"), spans.select(*place[:-1], F.col("first").cast("long"), F.col("last").cast("long"),
                                           covered.alias("covered"), (covered >= needed).alias("verified"))


def _labels(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    rows, spans = scan(docs)
    base = F.col("verified") & F.col("base")
    found = spans.groupBy("doc_id", "mark").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), _labels(base).alias("base_labels"),
        _labels(F.col("verified")).alias("labels"), F.max("covered").alias("score"))
    a, b = rows.alias("a"), found.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.mark").eqNullSafe(F.col("b.mark"))
    return a.join(b, same, "left").select(
        "a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
