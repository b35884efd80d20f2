"""From raw documents to packed training sequences: language ID, line dedup, near duplicates, decontamination, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns all that it keeps of docs, with the
columns of docs (the last one returns pieces of sequences). run() writes each result as Parquet in the shared folder and reads
it again for the next, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import common, decontaminate, language_id, line_dedup, ngram_join, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; letterless and foreign ones go."""
    model = language_id.fit(docs, F.lit(True))
    lang, score, rejected = (common.free_name(docs, x) for x in ("lang_pred", "score", "rejected"))
    return language_id.predict(docs, model, out=(lang, score, rejected)).where(~F.col(rejected)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stand in one document only; a document that loses all its text goes."""
    found = line_dedup.dedup_lines(docs)
    n_dropped, kept = found.columns[-2:]
    gone = (F.col(n_dropped) > 0) & (F.btrim(F.col(kept), F.lit(line_dedup.BLANKS)) == "")
    return found.where(~gone).withColumns({"text": F.col(kept), "n_chars": F.length(kept).cast("bigint")}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word similarity of 0.8 or more connects, the one of least id stays; of rows of one id and text, one."""
    found = ngram_join.entries(docs)
    others = found.where(~F.col("first")).select(F.col("doc_id").alias("__other"), F.col("t").alias("__t")).distinct()
    left, key = docs.join(others, (docs["doc_id"] == others["__other"]) & (F.xxhash64("text") == others["__t"]), "left_anti"), ["doc_id", F.xxhash64("text")]
    if docs.where(F.col("doc_id").isNotNull()).groupBy(*key).count().where("count > 1").isEmpty():  # texts needn't move for it
        return left
    place = common.free_name(docs, "place")
    rows = left.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns))))
    return rows.where((F.col(place) == 1) | F.col("doc_id").isNull()).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of nothing else goes."""
    kept = common.free_name(docs, "kept")
    left = decontaminate.remove_spans(docs.withColumn(kept, F.xxhash64("text")), common.read(spark, sf_dir, "benchmark"))
    cut = ~F.xxhash64("text").eqNullSafe(F.col(kept))
    left = left.where(~cut | F.col("text").rlike(common.WORD))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their sequences and places there."""
    return packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", benchmark_free), ("best_fit_packing", packed)]
#: SQL can't express the language models and the packing; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
