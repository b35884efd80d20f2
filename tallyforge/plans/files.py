"""Queries of sources, sinks and model contracts: they write to the shared folder and read what they wrote."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, models, select, sequences
from ..sources import arrays, ledger, readers, scratch, sinks, views
from ..sources.views import SQL_EV, table
from .base import query


def _docs(s, d):
    return table(s, d, "documents")


@query("src01_snk01_json_lines", "SELECT doc_id, lang, text FROM documents")
def json_lines(s, d):
    at = scratch.path(s, "lines")
    sinks.write_json_lines(_docs(s, d).select("doc_id", "lang", "text"), at)
    return readers.json_lines(s, at, "doc_id bigint, lang string, text string")


@query("src02_tolerant_json_lines", "SELECT count(*) AS rows, count(*) FILTER (lang = 'es') AS invalid FROM documents")
def tolerant(s, d):
    at = scratch.path(s, "lines")
    _docs(s, d).select(F.when(F.col("lang") == "es", "not a record").otherwise(F.to_json(F.struct("doc_id"))).alias("value")).write.text(at)
    return readers.invalid_count(readers.tolerant_json_lines(s, at, "doc_id bigint").select("doc_id", "_bad"))


def _document(s, d, wrap):
    """All documents as one JSON array in one file; a null at its end stands for the comma before it."""
    at = scratch.path(s, "document")
    record = F.to_json(F.struct("doc_id", "lang", "text"))
    rows = _docs(s, d).select(F.lit(1).alias("kind"), F.concat(wrap(record), F.lit(",")).alias("value"))
    ends = s.createDataFrame([(0, "["), (2, "null]")], "kind int, value string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("kind").select("value").write.text(at)
    return f"{at}/part-*"


@query("src03_json_document", "SELECT doc_id, lang, text FROM documents")
def json_document(s, d):
    return readers.json_elements(s, _document(s, d, lambda r: r), "doc_id bigint, lang string, text string")


@query("src04_nested_records", "SELECT doc_id, lang FROM documents")
def nested(s, d):
    at = _document(s, d, lambda r: F.concat(F.lit('{"deep": [{"er": '), r, F.lit("}, 3]}")))
    return readers.nested_records(s, at, "doc_id").select(F.from_json("record", "doc_id bigint, lang string").alias("x")).select("x.*")


@query("src07_npy_rows", "SELECT label, place, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS place FROM embeddings) GROUP BY 1, 2", places=4)
def npy(s, d):
    at = scratch.path(s, "arrays")

    def pack(batches):
        for rows in batches:
            for label, own in rows.groupby("label"):
                out = io.BytesIO()
                np.save(out, np.stack(own["v"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"label": [label], "value": [out.getvalue()]})

    packed = table(s, d, "embeddings").select("label", F.col("embedding").alias("v")).mapInPandas(pack, "label int, value binary")
    named = packed.withColumns({"value": F.col("value").cast("string"), "part": F.spark_partition_id(), "n": F.monotonically_increasing_id()})
    named.write.partitionBy("label", "part", "n").text(at)  # the line feed that ends a file is beyond the array
    rows = readers.npy_rows(s, f"{at}/label=*/part=*/n=*/part-*")
    own = rows.select(F.regexp_extract("path", r"label=(-?\d+)", 1).cast("int").alias("label"), F.posexplode("v").alias("place", "x"))
    return own.groupBy("label", F.col("place").cast("bigint").alias("place")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query(
    "src07_snk08_array_slots",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id AS place, len(v) AS width, round(v[1], 4) + 0.0 AS first, round(list_sum(v), 4) + 0.0 AS total, (SELECT count(*) FILTER (vec_id % 3 = 2) FROM e) AS pending_once FROM e""",
    places=4,
)
def array_slots(s, d):
    """Vectors as slots of one array by their id, filled in two goes; the second fills what the first left."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("place"), F.col("embedding").cast("array<double>").alias("v"))
    n, width = e.agg(F.max("place") + 1, F.max(F.size("v"))).first()
    at = scratch.path(s, "slots")
    arrays.write_slots(e.where("place % 3 < 2"), at, n, width, 1024)
    left = arrays.pending_slots(s, at)
    pending = left.join(e.select("place"), "place", "left_semi").count()
    arrays.write_slots(e.join(left, "place", "left_semi"), at, n, width)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return arrays.read_slots(s, at, 1 << 20).where(~F.isnan(F.get("v", F.lit(0)))).select("place", F.size("v").cast("bigint").alias("width"), F.get("v", F.lit(0)).alias("first"), total.alias("total"), F.lit(pending).cast("bigint").alias("pending_once"))


@query("snk02_snk09_canonical_manifest", """SELECT sha256('{"counts":{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '},"unknown":null}') AS h FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def manifest(s, d):
    counts = {x["lang"]: x["count"] for x in _docs(s, d).groupBy("lang").count().collect()}  # a row for each language
    return s.createDataFrame([(sinks.canonical_hash(sinks.plain({"unknown": float("nan"), "counts": counts})),)], "h string")


@query("snk03_refuse_overwrite", "SELECT TRUE AS refused, count(*) AS n FROM nation")
def refuse(s, d):
    at, nation = scratch.path(s, "once"), table(s, d, "nation")
    sinks.write_json_lines(nation, at)
    try:
        sinks.write_json_lines(nation.limit(1), at)
        refused = False
    except Exception as e:
        refused = bool(re.search("EXISTS", str(e), re.I))
    return readers.json_lines(s, at).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("snk02_snk07_ledger_parts", "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, CAST('lost, missing' AS VARCHAR) AS again FROM documents")
def ledger_parts(s, d):
    """Work on all documents in parts; a part and another's entry get lost, and only these two are done again."""
    at, docs = scratch.path(s, "parts"), _docs(s, d).select("doc_id", "text")
    work = lambda rows: rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    ledger.run_parts(docs, at, ["doc_id"], work, 12, {"work": "length"})
    scratch.drop(s, f"{at}/part-000003")
    scratch.drop(s, f"{at}/ledger/000007.json")
    again = ledger.run_parts(docs, at, ["doc_id"], work, 12, {"work": "length"})
    return ledger.read_parts(s, at).select("doc_id", "n").withColumn("again", F.lit(", ".join(again[k] for k in sorted(again))))


query("srt05_length_sorted", "SELECT doc_id, n_chars FROM documents")(lambda s, d: _docs(s, d).sortWithinPartitions(F.length("text")).select("doc_id", "n_chars"))
query("sel30_bounded_residual", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(rm + 1.5 * (exp(2 * sin(rm)) - 1) / (exp(2 * sin(rm)) + 1), 6) + 0.0 AS score FROM v")(
    lambda s, d: views.event_candidates(s, d).select("question_uid", "candidate_index", select.bounded_residual(F.col("rm"), F.sin("rm"), 1.5).alias("score"))
)


def _length_model():
    return lambda texts: [float(len(t)) for t in texts]


query("mdl01_score_texts", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents")(lambda s, d: models.score_texts(_docs(s, d).select("doc_id", "text"), "text", _length_model).select("doc_id", "score"))


def _echo():
    return lambda problem, seed: f"{problem} #### {seed % 7}" if seed % 3 else "no answer"


@query("mdl02_generate_recover")
def generated(s, d):
    q = table(s, d, "nation").select(F.col("n_nationkey").alias("question_uid"), F.col("n_name").alias("problem"))
    c = models.generate(q, _echo, 16)
    return models.recover(c, F.nullif(F.regexp_extract("solution_text", "#### (\\d+)", 1), F.lit("")), _echo).select("question_uid", "candidate_index", "solution_text", "stage")


_N8 = "CAST(embedding AS DOUBLE[])"
query("mdl03_nll_stats", f"SELECT vec_id, round(list_avg(v), 6) + 0.0 AS mean, round(list_aggregate(v, 'quantile_cont', 0.9), 6) + 0.0 AS p90, round(list_max(v), 6) + 0.0 AS most, round(list_avg(v[len(v) - 7:len(v)]), 6) + 0.0 AS last8, round(list_aggregate(v, 'stddev_pop'), 6) + 0.0 AS sd FROM (SELECT vec_id, {_N8} AS v FROM embeddings)")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", models.nll_stats(F.col("embedding").cast("array<double>")).alias("x")).select("vec_id", "x.*")
)
query("mdl04_p_true", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(1 / (1 + exp(-rm / 10)), 6) AS p FROM v")(
    lambda s, d: views.event_candidates(s, d).select("question_uid", "candidate_index", sequences.p_true(F.col("rm") / 10, F.lit(0.0)).alias("p"))
)


@query("lrn06_lrn07_layer_probes")
def probes(s, d):
    e = table(s, d, "embeddings").select(F.col("label").alias("question_uid"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    layers = e.select("question_uid", "label", F.posexplode(F.array(*[F.slice("v", k * 16 + 1, 16) for k in range(4)])).alias("layer", "v"))
    return models.layer_probes(layers)


@query("txt03_txt05_token_places")
def places(s, d):
    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                spans = [m.span() for m in re.finditer(r"\S+", t or "")]
                ends = T.chunk_ends(t or "")
                out.append((i, len(ends), models.token_places(ends, spans)))
            yield pd.DataFrame(out, columns=["doc_id", "n_chunks", "places"])

    return _docs(s, d).select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_chunks int, places array<int>")


@query("txt03_txt05_token_offsets")
def token_offsets(s, d):
    """Chunk ends of all documents as tokens of a byte-level vocabulary: the text is the solution, its source the problem."""
    import public_tokenizers

    return chunks.chunk_tokens(_docs(s, d).select("doc_id", "source", "text"), "doc_id", "source", "text", public_tokenizers.path("byte_bpe_50k.json"))
