"""License scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm.common import UPPER, fingerprint_of, table, text_of

# The contract's phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Wording of well-known public licenses and of the notices that name them: (label, words, words that must be
# met whatever the share, as they tell versions apart).
TEMPLATES = [
    ("mit", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ""),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ""),
    ("apache-2.0", "apache license version 2 0", "2"),
    ("apache-2.0", "apache license 2 0", "2"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "2"),
    ("apache-2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ""),
    ("gpl", "gnu general public license", ""),
    ("gpl-2.0", "general public license version 2", "2"),
    ("gpl-3.0", "general public license version 3", "3"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "2 general"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "3 general"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "general"),
    ("lgpl", "gnu lesser general public license", "lesser"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    ("agpl-3.0", "gnu affero general public license", "affero"),
    ("mpl-2.0", "mozilla public license version 2 0", "2"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ""),
    ("epl-2.0", "eclipse public license version 2 0", "2"),
    ("bsl-1.0", "boost software license version 1 0", "1"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("cc0-1.0", "cc0 1 0 universal", "cc0"),
    ("cc-by-3.0", "cc by 3 0", "3"),
    ("cc-by-4.0", "cc by 4 0", "4"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "3"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "4"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "4"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "4"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "4"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "4"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "4"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", "sharealike 4"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", "noncommercial 4"),
]
#: Words of a rolling gram of templates of fewer than LONG words, and of longer ones; diagonals that are merged.
SHORT_K, LONG_K, LONG, BAND = 2, 4, 10, 2
_BLANK = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def gram_of(m: int) -> int:
    return SHORT_K if m < LONG else LONG_K


def needed(m: int) -> float:
    """The share of a template of m words that a span must hold: all of a short one, seven tenths of a passage."""
    return 1.0 if m < LONG else 0.7


def templates() -> list[tuple[list[str], str, set[int], bool]]:
    """(words, label, places that must be met, whether it is a base phrase); all places of a base phrase must."""
    base = [(p.split(), label, set(range(len(p.split()))), True) for p, label in BASE]
    return base + [(w.split(), label, {i for i, x in enumerate(w.split()) if x in must.split()}, False) for label, w, must in TEMPLATES]


def words_of(text):
    """Lower-cased (A-Z only) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as an array."""
    plain = F.translate(text, UPPER + _BLANK, UPPER.lower() + " " * len(_BLANK))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, t, j, k, m, need, must, label, base): every gram of every template; the lists above fix how many."""
    rows = [("", -1, 0, SHORT_K, 0, 0.0, [], "", False)]  # each text sends one empty gram, so texts without hits stay
    for t, (w, label, must, base) in enumerate(templates()):
        m, k = len(w), gram_of(len(w))
        rows += [(" ".join(w[j : j + k]), t, j, k, m, needed(m), sorted(must), label, base) for j in range(m - k + 1)]
    return spark.createDataFrame(rows, "gram string, t int, j int, k int, m int, need double, must array<int>, label string, base boolean").withColumn("h", F.xxhash64("gram"))


def rolling(w: Column, k: int) -> Column:
    """All k-grams of an array of words, as array<struct<i, said>>."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, i + 1, k), " ").alias("said")))
    return F.when(F.size(w) >= k, grams).otherwise(F.array().cast("array<struct<i:int,said:string>>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All rolling grams of every text meet the templates' grams by hash in a broadcast join (the templates are fixed and
    few) and are compared word for word; hits vote for the diagonal (text position less template position). Neighbouring
    diagonals of a long template are merged, so a passage with words put in or left out is one span. A base phrase stands where all its grams
    vote; another template where its span holds needed() of its words and those that tell versions apart. Each text sends
    one empty gram as well, so texts without hits stay and one scan does. score is the largest share found. Null texts
    count as empty: no words, labels ''. Rows that repeat id and text are each returned. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", fingerprint_of(text).alias("row"), words_of(text).alias("w")).withColumn("n_words", F.size("w"))
    w = F.col("w")
    mark = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("said")))
    said = rows.select("doc_id", "row", "n_words", F.explode(F.concat(rolling(w, SHORT_K), rolling(w, LONG_K), mark)).alias("g")).select("doc_id", "row", "n_words", "g.i", "g.said")
    hits = said.join(F.broadcast(template_grams(spark)), (F.xxhash64("said") == F.col("h")) & (F.col("said") == F.col("gram")))
    key, of = ["doc_id", "row", "n_words"], ["t", "k", "m", "need", "must", "label", "base"]
    votes = hits.groupBy(*key, *of, (F.col("i") - F.col("j")).alias("d")).agg(F.collect_set("j").alias("js"), F.count("*").alias("n"))
    order = Window.partitionBy(*key, "t").orderBy("d")
    apart = F.when((F.col("m") < LONG) | (F.col("t") < 0) | F.lag("d").over(order).isNull() | (F.col("d") - F.lag("d").over(order) > BAND), 1).otherwise(0)
    spans = votes.withColumn("span", F.sum(apart).over(order)).groupBy(*key, *of, "span").agg(F.min("d").alias("d"), F.flatten(F.collect_list("js")).alias("js"), F.sum("n").alias("n"))
    spans = spans.withColumn("met", F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    spans = spans.withColumn("share", F.when(F.col("t") >= 0, F.size("met") / F.col("m")))
    spans = spans.filter((F.col("t") < 0) | (F.col("share") >= F.col("need")) & (F.size(F.array_except("must", "met")) == 0))
    base = F.col("base") & (F.col("t") >= 0)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*key).agg(
        F.sum(F.when(F.col("t") < 0, F.col("n"))).alias("times"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("d"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("d"))).cast("long").alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels(F.when(F.col("t") >= 0, F.col("label"))).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
