"""Line dedup with DataFrame functions only.

Every text is split at line feeds. A line's key is the line without the characters 0x20 and 0x09-0x0D at both ends and with
A-Z lower-cased; it is held as two 64-bit hashes, so that as many lines as there are have no equal pair by chance. Keys of
``min_chars`` code points or more found in ``min_docs`` documents or more lose their lines except in the largest document
id that has them.

Plan: (key, id) pairs are made distinct before they meet (partial aggregates, then by key and id, then by key), so that a
line that all documents share is a few rows for each task. Frequent keys join the line places by key and one of ``SALTS``
salts (a hash of the document), so a hot key's places meet in as many tasks. Of these only places to drop go on, as one array
for each document, which a join by row key brings to the text. Texts move once; lines never do.

Cases: a null or empty text is one empty line; a row whose id is null counts as no document and keeps its lines; rows that
repeat an id count as one document and are each answered (rows equal in id and text alike); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 16
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with n_lines, n_dropped and kept (the remaining lines, joined)."""
    key_a, key_b, drop, n_lines, n_dropped, kept_ = (common.free_name(df, x) for x in ("__row_a", "__row_b", "__drop", "n_lines", "n_dropped", "kept"))
    lines = common.free_name(df, "__lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(7), whole).alias("b"))
    keys = F.transform(F.split(common.ascii_lower(whole), "\n", -1), line_key)
    hashed = F.transform(keys, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("x"), F.xxhash64(F.lit(7), k).alias("y"), i.alias("at"))))
    places = (
        df.where(F.col(doc_id).isNotNull())
        .select(row.alias("row"), F.filter(hashed, lambda x: x.isNotNull()).alias("lines"))
        .select("row", F.explode_outer("lines").alias("line"))  # explode() would compute lines twice, for a filter on their number
        .where(F.col("line").isNotNull())
        .select(F.col("row.id").alias("id"), F.col("row.a").alias("a"), F.col("row.b").alias("b"), "line.x", "line.y", "line.at")
    )
    often = places.groupBy("x", "y").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("x", "y", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    drops = (
        places.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(often, ["x", "y", "salt"]).where(F.col("id") != F.col("keeper"))
        .groupBy(F.col("id").alias(doc_id), F.col("a").alias(key_a), F.col("b").alias(key_b)).agg(F.collect_set("at").alias(drop))
    )
    keyed = df.withColumns({key_a: F.xxhash64(whole), key_b: F.xxhash64(F.lit(7), whole)})
    dropped = F.coalesce(F.size(drop), F.lit(0))
    # lines must be a column: as an expression it would be split again for every place that the lambda reads
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda i: F.get(lines, i))
    found = keyed.join(drops, [doc_id, key_a, key_b], "left").withColumn(lines, F.split(whole, "\n", -1))
    return found.select(
        *[keyed[c] for c in df.columns],
        F.size(lines).cast("bigint").alias(n_lines),
        dropped.cast("bigint").alias(n_dropped),
        F.when(F.col(drop).isNull(), whole).otherwise(F.array_join(left, "\n")).alias(kept_),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l[i] AS line, i, trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
often AS (SELECT k, max(doc_id) AS keeper FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT x.doc_id, x.line, x.i, o.k IS NULL OR x.doc_id = o.keeper AS stays FROM x LEFT JOIN often o ON x.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM y GROUP BY doc_id
"""
