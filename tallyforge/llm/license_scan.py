"""License scans by diagonal voting, with DataFrame functions only.

Rolling hashes of k consecutive words of every text (k = 2 for the base phrases, k = 4 for whole notices) are joined to the
places of the same k-grams in the templates. The templates are a fixed list of this module, so their table is small at any
size of the corpus and is broadcast. A hit votes for its diagonal (place in the text less place in the template). A phrase
stands where all its k-grams vote for one diagonal. For notices, diagonals of one template that lie within ``slack`` words of
each other merge (words inserted or left out), and a merged span is a match if it covers ``min_cover`` of the template's
k-grams. Every hit is verified word by word against the template before it votes.

A text's own hashes that no template has are left out before they are exploded; the words of the others go with them, so work
follows the length of a text. Only hits and one row for each document are shuffled. Cases: a null or empty text has no words and no labels; rows that
repeat an id with another text are answered apart, rows equal in id and text alike; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Public license notices, lower-cased words, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit-notice"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0-notice"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl-notice"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense-notice"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0-notice"),
    ("this work is licensed under the gnu general public license version", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    ("released under the mit license", "mit-notice"),
    ("licensed under cc by", "cc-notice"),
    ("boost software license version 1 0", "bsl-1.0-notice"),
]
SHORT, LONG = 2, 4


def rolled(hashes: Column, by: int) -> Column:
    """Hashes of twice as many words as each of hashes is of."""
    n = F.size(hashes) - by
    return F.when(n > 0, F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession) -> DataFrame:
    """One row for each k-gram of each template, with the very hashes that texts get."""
    every = [(*x, True) for x in PHRASES] + [(*x, False) for x in NOTICES]
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.split(F.lit(text), " ").alias("words")) for i, (text, label, base) in enumerate(every)]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    one = F.transform("words", lambda w: F.xxhash64(w))
    two = rolled(one, 1)
    four = rolled(two, 2)
    k = F.when(F.col("base"), SHORT).otherwise(LONG)
    grams = F.when(F.col("base"), two).otherwise(four)
    return t.select("template", "label", "base", "words", F.size("words").alias("length"), F.size(grams).alias("n_grams"), k.alias("k"), F.posexplode(grams).alias("t_at", "t_hash")).withColumn("t_words", F.slice("words", F.col("t_at") + 1, F.col("k"))).drop("words")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slack: int = 3, min_cover: float = 0.8) -> DataFrame:
    """For each row: n_words, n_base, first_word, last_word, base_labels, labels, score and spans of the notices found."""
    spark = df.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("a"), F.regexp_extract_all(common.ascii_lower(whole), F.lit(f"({common.WORD})"), 1).alias("words"))
    docs = docs.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("two", rolled(F.col("one"), 1))
    docs = docs.select("id", "a", "words", "two", rolled(F.col("two"), 2).alias("four"))
    table = templates(spark)
    have = {k: [x.t_hash for x in table.where(F.col("k") == k).select("t_hash").distinct().collect()] for k in (SHORT, LONG)}  # of the fixed list

    def places(hashes: str, k: int) -> Column:
        """The places in a text whose hash some template has. words must be a column, not an expression: this reads it by place."""
        one = lambda h, i: F.when(h.isin(have[k]), F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("hash"), F.slice("words", i + 1, F.lit(k)).alias("words")))
        return F.filter(F.transform(hashes, one), lambda x: x.isNotNull())

    # one place more, -1, stands for the row itself: so that rows without a hit stay, and texts are read once
    none = F.array().cast("array<string>")
    row = F.array(F.struct(F.lit(0).alias("k"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("hash"), none.alias("words")))
    grams = docs.select("id", "a", F.size("words").alias("n_words"), F.concat(row, places("two", SHORT), places("four", LONG)).alias("g"))
    grams = grams.select("id", "a", "n_words", F.explode_outer("g").alias("g"))  # explode() would compute g twice, for a filter on its size, and there with words as an expression
    own = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("length"), F.lit(0).alias("n_grams"),
        F.lit(0).alias("k"), F.lit(-1).alias("t_at"), F.lit(0).cast("bigint").alias("t_hash"), none.alias("t_words"),
    )
    same = (F.col("g.hash") == F.col("t_hash")) & (F.col("g.k") == F.col("k")) & (F.col("g.words") == F.col("t_words"))
    hits = grams.join(F.broadcast(table.unionByName(own)), same).select("id", "a", F.when(F.col("k") == 0, F.col("n_words")).alias("n_words"), "template", "label", "base", "length", "n_grams", "t_at", (F.col("g.at") - F.col("t_at")).alias("diagonal"))
    votes = hits.groupBy("id", "a", "template", "label", "base", "length", "n_grams", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("rows"), F.collect_set("t_at").alias("votes")
    )
    line = Window.partitionBy("id", "a", "template").orderBy("diagonal")
    fresh = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(line) <= slack), F.when(F.col("base"), 1).otherwise(0)).otherwise(1)
    merged = (
        votes.withColumn("span", F.sum(fresh).over(line))
        .groupBy("id", "a", "template", "label", "base", "length", "n_grams", "span")
        .agg(
            F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("cover"),
            F.min(F.col("diagonal") + F.array_min("votes")).alias("begin"), F.max(F.col("diagonal") + F.array_max("votes") + LONG).alias("end"),
            F.min("diagonal").alias("diagonal"),
        )
    )
    cover = F.col("cover") / F.col("n_grams")
    phrase = F.col("base") & (F.col("cover") == F.col("n_grams"))
    notice = ~F.col("base") & (F.col("template") >= 0) & (cover >= min_cover)
    found = F.when(phrase | notice, F.col("label"))
    out = merged.groupBy("id", "a").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("rows"),
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(phrase, F.col("diagonal"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(found)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.when(F.col("base"), F.when(phrase, 1.0)).otherwise(cover))), F.lit(0.0)).cast("double").alias("score"),
        F.sort_array(F.collect_list(F.when(notice, F.struct("begin", "end", "label")))).alias("spans"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).select(
        F.col("id").alias(doc_id), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The same by comparing words, not hashes."""
    rows = ",\n  ".join(f"({i}, '{label}', {str(base).upper()}, {SHORT if base else LONG}, string_split('{text}', ' '))" for i, (text, label, base) in enumerate([(*x, True) for x in PHRASES] + [(*x, False) for x in NOTICES]))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, base, k, tw) AS (VALUES
  {rows}),
tg AS (SELECT template, label, base, k, n_grams, t_at, array_to_string(tw[t_at + 1:t_at + k], ' ') AS g FROM (SELECT *, len(tw) - k + 1 AS n_grams, unnest(range(0, len(tw) - k + 1)) AS t_at FROM t)),
dg AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (VALUES ({SHORT}), ({LONG})) x(k) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, template, label, base, n_grams, t_at, p - t_at AS diagonal FROM dg JOIN tg USING (k, g)),
diag AS (SELECT DISTINCT doc_id, template, base, diagonal FROM hit),
sp AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM (SELECT *, CASE WHEN base OR lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) IS NULL OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS fresh FROM diag)),
m AS (SELECT doc_id, template, span, any_value(label) AS label, any_value(base) AS base, any_value(n_grams) AS n_grams, count(DISTINCT t_at) AS cover, min(diagonal) AS diagonal FROM hit JOIN sp USING (doc_id, template, diagonal) GROUP BY 1, 2, 3),
f AS (SELECT *, base AND cover = n_grams AS phrase, NOT base AND cover / n_grams >= 0.8 AS notice FROM m)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (phrase) AS n_base, CAST(min(diagonal) FILTER (phrase) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (phrase) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase OR notice), '') AS labels,
  coalesce(max(CASE WHEN phrase THEN 1.0::DOUBLE WHEN NOT base THEN cover / n_grams END), 0.0::DOUBLE) AS score
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


OP1_SQL = _sql()
