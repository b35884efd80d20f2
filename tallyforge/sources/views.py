"""Candidate views over the star-schema tables, as DataFrames and as SQL text.

A candidate table has question_uid, candidate_index, answer, rm, label and solution. Rows of DataFrames have no order, so the
index comes from an explicit, total order of each question's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with candidate_index: the row's place in its group, from 0."""
    return df.withColumn("candidate_index", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))


LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def lineitem_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(table(spark, sf_dir, "lineitem"), "l_orderkey", LI_ORDER).select(
        F.col("l_orderkey").alias("question_uid"), "candidate_index", F.col("l_returnflag").alias("answer"), F.col("l_extendedprice").alias("rm"),
        (F.col("l_linestatus") == "O").cast("int").alias("label"), F.col("l_suppkey").cast("string").alias("solution"),
    )


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(
        F.col("user_id").alias("question_uid"), "candidate_index", F.col("event_type").alias("answer"), F.col("value").alias("rm"),
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("label"), F.col("event_id").cast("string").alias("solution"),
    )


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, grouped by source."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return indexed(docs, "source", ["doc_id"]).select(
        F.col("source").alias("question_uid"), "candidate_index", F.col("lang").alias("answer"), F.col("n_chars").cast("double").alias("rm"),
        F.col("quality").cast("int").alias("label"), F.col("text").alias("solution"),
    )


def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(table(spark, sf_dir, "embeddings"), "label", ["vec_id"]).select(
        F.col("label").alias("question_uid"), "candidate_index", (F.col("vec_id") % 3).cast("string").alias("answer"),
        F.get("embedding", F.lit(0)).cast("double").alias("rm"), "vec_id", F.col("embedding").cast("array<double>").alias("v"),
    )


#: The same views for the oracle.
SQL_LI = f"""v AS (SELECT l_orderkey AS question_uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LI_ORDER)}) - 1 AS candidate_index,
  l_returnflag AS answer, l_extendedprice AS rm, CAST(l_linestatus = 'O' AS INTEGER) AS label, CAST(l_suppkey AS VARCHAR) AS solution FROM lineitem)"""
SQL_EV = """v AS (SELECT user_id AS question_uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS candidate_index,
  event_type AS answer, value AS rm, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS label, CAST(event_id AS VARCHAR) AS solution FROM events)"""
SQL_DOC = """v AS (SELECT source AS question_uid, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS candidate_index,
  lang AS answer, CAST(n_chars AS DOUBLE) AS rm, CAST(quality AS INTEGER) AS label, text AS solution FROM documents JOIN labels USING (doc_id))"""
SQL_EMB = """v AS (SELECT label AS question_uid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS candidate_index,
  CAST(vec_id % 3 AS VARCHAR) AS answer, CAST(embedding[1] AS DOUBLE) AS rm, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
