"""Queries of data-set construction: duplicates, contamination, splits, samples, set operations, projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsing as P
from ..functions import text as T
from ..operators import audit, corpus
from ..sources import readers, sinks, views
from ..sources.views import SQL_EV, SQL_LI, table
from .base import query, r

WS = "' \\t\\n\\x0B\\f\\r'"
SQUEEZE = "regexp_replace(lower({}), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', '', 'g')"
COLLAPSE = "lower(trim(regexp_replace({}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"


def docs(s, d):
    return table(s, d, "documents")


query("src06_parquet_scan_pruned", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")(lambda s, d: docs(s, d).where("lang = 'en'").select("doc_id", "lang"))
query("src05_dispatch_scan", "SELECT doc_id, n_chars FROM documents")(lambda s, d: readers.records(s, f"{d}/documents.parquet", ["doc_id", "n_chars"]))
query("src08_src10_checked_count", "SELECT count(*) AS n FROM documents")(lambda s, d: readers.checked(docs(s, d), docs(s, d).count()).agg(F.count("*").alias("n")))
query("src09_unique_key_violations", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")(lambda s, d: readers.repeated_keys(table(s, d, "conversations"), "conv_id"))
query("src11_ragged_slice", "SELECT vec_id, [round(x, 6) FOR x IN CAST(embedding[vec_id % 8 + 1 : vec_id % 8 + 4] AS DOUBLE[])] AS part FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(F.slice(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 8 + 1).cast("int"), 4), lambda x: F.signum(x) * F.round(F.abs(x), 6)).alias("part"))  # -0.0 stays, as in the SQL
)
query("prj01_prj02_flatten_roles", "SELECT conv_id, turn, role, 'train' AS data_role, 'conversations' AS source_dataset, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS candidate_index FROM conversations")(
    lambda s, d: views.indexed(table(s, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", F.lit("train").alias("data_role"), F.lit("conversations").alias("source_dataset"), "candidate_index")
)
query("prj03_reindex_after_cleaning", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS candidate_index FROM documents WHERE n_chars >= 200")(
    lambda s, d: views.indexed(docs(s, d).where("n_chars >= 200"), "source", ["doc_id"]).select("source", "doc_id", "candidate_index")
)
query("prj04_coalesce_text", "SELECT doc_id, coalesce(CASE WHEN length(trim(lang)) >= 20 THEN trim(lang) END, CASE WHEN length(trim(text)) >= 20 THEN trim(text) END) AS content FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", readers.first_text([F.col("lang"), F.col("text")]).alias("content"))
)
query("prj05_unpivot_pairs", "SELECT conv_id, turn, label, row_number() OVER (PARTITION BY conv_id ORDER BY label DESC, turn) - 1 AS candidate_index FROM (SELECT conv_id, turn, 1 AS label FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 0 FROM conversations WHERE role <> 'assistant')")(
    lambda s, d: (c := table(s, d, "conversations")) and views.indexed(
        c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("chosen"), F.collect_list(F.when(F.col("role") != "assistant", F.col("turn"))).alias("rejected"))
        .select("conv_id", F.explode(F.concat(F.transform("chosen", lambda t: F.struct(t.alias("turn"), F.lit(1).alias("label"))), F.transform("rejected", lambda t: F.struct(t.alias("turn"), F.lit(0).alias("label"))))).alias("x"))
        .select("conv_id", "x.turn", "x.label", (-F.col("x.label")).alias("o")), "conv_id", ["o", "turn"]).drop("o")
)
query("prj06_prj07_txt01_steps", r"SELECT doc_id, CAST(len(st) AS INTEGER) AS n_steps, array_to_string(st, ' | ') AS joined FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS st FROM documents)")(
    lambda s, d: docs(s, d).select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("st")).select("doc_id", F.size("st").alias("n_steps"), F.array_join("st", " | ").alias("joined"))
)
query("prj08_primary_domain", "SELECT page_id, trim(string_split(replace(url, '://', ' -> '), ' -> ')[1]) AS domain, trim(coalesce(string_split(replace(url, '://', ' -> '), ' -> ')[2], 'unknown')) AS leaf FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", F.split(F.replace("url", F.lit("://"), F.lit(" -> ")), " -> ").alias("p")).select("page_id", F.trim(F.try_element_at("p", F.lit(1))).alias("domain"), F.trim(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("unknown"))).alias("leaf"))
)
query("prj09_difficulty_bucket", "SELECT c_custkey, coalesce(CAST(CAST(round_even(TRY_CAST(nullif(c_acctbal, 0) AS DOUBLE) / 1000, 0) AS BIGINT) AS VARCHAR), 'unknown') AS bucket FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.coalesce(F.bround(F.nullif("c_acctbal", F.lit(0.0)).try_cast("double") / 1000, 0).cast("bigint").cast("string"), F.lit("unknown")).alias("bucket"))
)
RECOVER = "SELECT doc_id, CASE WHEN lang = 'es' THEN upper(source) ELSE source END AS source, CASE WHEN lang = 'es' THEN source END AS primary_source, CASE WHEN lang = 'es' THEN 'recovery' ELSE 'primary' END AS stage FROM documents"
query("prj10_prj11_jn15_recovery_merge", RECOVER)(lambda s, d: sinks.merge_versions(docs(s, d).select("doc_id", "source"), docs(s, d).where("lang = 'es'").select("doc_id", F.upper("source").alias("source")), ["doc_id"], ["source"]))
query("flt01_equality_filter", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src1'")(lambda s, d: docs(s, d).where("lang = 'de' AND source = 'src1'").select("doc_id"))
query("flt02_mixed_groups", f"WITH {SQL_LI}, g AS (SELECT question_uid FROM v GROUP BY 1 HAVING min(label) = 0 AND max(label) = 1) SELECT question_uid, candidate_index FROM v JOIN g USING (question_uid)")(lambda s, d: audit.mixed_groups(views.lineitem_candidates(s, d)).select("question_uid", "candidate_index"))
query("flt03_groups_of_k", f"WITH {SQL_LI}, g AS (SELECT question_uid FROM v GROUP BY 1 HAVING count(*) >= 4) SELECT question_uid, candidate_index FROM v JOIN g USING (question_uid)")(lambda s, d: audit.groups_of(views.lineitem_candidates(s, d), 4).select("question_uid", "candidate_index"))
query(
    "flt05_flt06_candidate_contract",
    f"""WITH {SQL_LI}, q AS (SELECT question_uid, count(*) AS n, count(DISTINCT candidate_index) AS d, min(candidate_index) AS lo, max(candidate_index) AS hi, count(*) FILTER (NOT isfinite(rm)) AS bad, count(*) FILTER (label NOT IN (0, 1)) AS lab FROM v GROUP BY 1)
SELECT unnest(['repeated_identity', 'incomplete_indices', 'not_finite', 'bad_label', 'forbidden_fields']) AS rule, unnest([count(*) FILTER (n <> d), count(*) FILTER (lo <> 0 OR hi <> n - 1), CAST(sum(bad) AS BIGINT), CAST(sum(lab) AS BIGINT), 0]) AS violations FROM q""",
)(lambda s, d: audit.candidate_contract(views.lineitem_candidates(s, d)))
query("flt07_finite", f"WITH {SQL_EV} SELECT question_uid, candidate_index FROM v WHERE isfinite(rm) AND rm > 5")(lambda s, d: views.event_candidates(s, d).where(audit.finite("rm") & (F.col("rm") > 5)).select("question_uid", "candidate_index"))
query("flt08_score_contract", "WITH e AS (SELECT doc_id FROM documents), x AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s FROM documents WHERE lang <> 'es') SELECT count(*) AS rows, count(*) FILTER (s IS NULL) AS missing, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS not_finite FROM e LEFT JOIN x USING (doc_id)")(
    lambda s, d: audit.score_contract(docs(s, d).where("lang <> 'es'").select("doc_id", F.col("n_chars").cast("double").alias("s")), docs(s, d), ["doc_id"], "s").drop("key_sum")
)
query("flt09_strict_parse", "SELECT doc_id, CASE WHEN source = 'src3' THEN NULL ELSE lang END AS answer FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", P.strict_answer(F.col("lang"), F.when(F.col("source") == "src3", "last_number").otherwise("hash")).alias("answer"))
)
_PAT = ["the ", "de ", "tion"]
_REP = " + ".join(f"CAST((length(t) - length(replace(t, '{p}', ''))) / {len(p)} AS INTEGER)" for p in _PAT)
query("flt10_str09_repetition_score", f"SELECT doc_id, {_REP} AS score, CASE WHEN {_REP} >= 10 THEN 'restart_efficient' ELSE 'continue_finalize' END AS mode FROM (SELECT doc_id, lower(right(text, 2500)) AS t FROM documents)")(
    lambda s, d: docs(s, d).select("doc_id", T.repetition_score(F.col("text"), _PAT).alias("score")).select("doc_id", "score", T.recovery_mode(F.col("score")).alias("mode"))
)
query("jn01_jn02_jn03_attach_scores", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(rm * 2, 6) AS score FROM v")(
    lambda s, d: (c := views.event_candidates(s, d)) and readers.attach_scores(c.select("question_uid", "candidate_index"), c.select("question_uid", "candidate_index", (F.col("rm") * 2).alias("score")), ["question_uid", "candidate_index"])
)
query("jn04_jn08_alignment_check", "SELECT count(*) FILTER (b.doc_id IS NULL) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) FILTER (b.doc_id IS NOT NULL AND a.lang <> b.lang) AS differing FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN source = 'src1' THEN 'xx' ELSE lang END AS lang FROM documents WHERE source <> 'src2') b USING (doc_id)")(
    lambda s, d: audit.aligned(docs(s, d), docs(s, d).where("source <> 'src2'").withColumn("lang", F.when(F.col("source") == "src1", "xx").otherwise(F.col("lang"))), ["doc_id"], ["lang"])
)
query("jn05_jn06_jn07_gold_coverage", "SELECT count(*) AS documents, count(l.doc_id) AS labelled, CAST((SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS stray FROM documents d LEFT JOIN labels l USING (doc_id)")(
    lambda s, d: docs(s, d).select("doc_id").join(table(s, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full").join(docs(s, d).select("doc_id", F.lit(1).alias("x")), "doc_id", "left").agg(F.count("x").alias("documents"), F.count_if(F.col("x").isNotNull() & F.col("l").isNotNull()).alias("labelled"), F.count_if(F.col("x").isNull()).alias("stray"))
)
query("jn06_semi_join_targets", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")(lambda s, d: table(s, d, "labels").join(docs(s, d).where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality"))
query("set05_first_of_each", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SQUEEZE.format('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")(lambda s, d: corpus.first_of_each(docs(s, d), T.squeeze(F.col("text")), "doc_id").select("doc_id"))
query("jn11_internal_duplicates", f"SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {SQUEEZE.format('text')}) AS f FROM documents) WHERE doc_id > f")(lambda s, d: corpus.internal_duplicates(docs(s, d), T.squeeze(F.col("text")), "doc_id"))
query("jn11_exact_matches", f"WITH e AS (SELECT {SQUEEZE.format('text')} AS k, min(doc_id) AS external_id FROM documents GROUP BY 1) SELECT doc_id, external_id FROM (SELECT doc_id, {SQUEEZE.format('text')} AS k FROM documents) JOIN e USING (k)")(
    lambda s, d: corpus.exact_matches(docs(s, d), docs(s, d), T.squeeze(F.col("text")), T.squeeze(F.col("text")), "doc_id", "doc_id")
)
query("jn12_contamination_contains", f"SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({COLLAPSE.format('d.text')}, {COLLAPSE.format('b.text')})")(
    lambda s, d: corpus.contains_matches(docs(s, d), table(s, d, "benchmark"), "doc_id", "text", "item_id", "text")
)
query("jn12_str10_fuzzy_best")(lambda s, d: corpus.fuzzy_best(docs(s, d), table(s, d, "benchmark"), "doc_id", "text", "item_id", "text", 50.0))
query("jn12_jn11_contamination")(lambda s, d: corpus.contamination(docs(s, d), table(s, d, "benchmark"), "doc_id", "text", "item_id", "text"))
_top = lambda s, d: corpus.fuzzy_top(table(s, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("t")), table(s, d, "benchmark"), "q", "t", "item_id", "text", 5)
query("jn13_str10_str11_fuzzy_top5")(_top)
query("jn13_match_risk", "SELECT item_id AS q, TRUE AS exact_match, TRUE AS high_risk, TRUE AS review, 100.0::DOUBLE AS score, 100.0::DOUBLE AS token_score FROM benchmark WHERE regexp_matches(lower(text), '[a-z0-9]')")(lambda s, d: corpus.match_risk(_top(s, d), "q"))
query("jn14_exclusion_reasons", "WITH w AS (SELECT doc_id, 'short' AS reason FROM documents WHERE n_chars < 300 UNION ALL SELECT doc_id, 'spanish' FROM documents WHERE lang = 'es') SELECT doc_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM w GROUP BY 1")(
    lambda s, d: corpus.excluded(docs(s, d).select("doc_id"), docs(s, d).where("n_chars < 300").select("doc_id", F.lit("short").alias("reason")).unionByName(docs(s, d).where("lang = 'es'").select("doc_id", F.lit("spanish").alias("reason"))), "doc_id")[1]
)
@query("jn12_jn14_smp03_audited_split")
def audited_split(s, d):
    """All documents against the benchmark: a split, or the reasons why not."""
    ratios = {"train": 0.65, "calibration": 0.1, "pilot": 0.1, "test": 0.15}
    split, out, _ = corpus.audited_split(docs(s, d), table(s, d, "benchmark"), "doc_id", "text", "item_id", "text", F.concat_ws("|", "source", "lang"), ratios, "s3")
    return split.select("doc_id", "stratum", "split", F.lit(None).cast("string").alias("reasons")).unionByName(out.select("doc_id", F.lit(None).cast("string").alias("stratum"), F.lit(None).cast("string").alias("split"), "reasons"))


query("jn14_anti_join_kept", "SELECT doc_id FROM documents WHERE NOT (n_chars < 300 OR lang = 'es')")(
    lambda s, d: corpus.excluded(docs(s, d).select("doc_id"), docs(s, d).where("n_chars < 300 OR lang = 'es'").select("doc_id", F.lit("x").alias("reason")), "doc_id")[0]
)
query("agg32_duplicate_records", "SELECT md5(text) AS signature, doc_id, count(*) OVER w AS n, v.variants FROM documents JOIN (SELECT md5(text) AS k, count(DISTINCT source) AS variants FROM documents GROUP BY 1) v ON k = md5(text) WINDOW w AS (PARTITION BY md5(text)) QUALIFY n > 1")(
    lambda s, d: corpus.duplicate_records(docs(s, d), F.md5(F.col("text").cast("binary")), "doc_id", F.col("source"))
)
query("jn18_set06_split_overlap", f"WITH k AS (SELECT DISTINCT source, {COLLAPSE.format('text')} AS k FROM documents) SELECT a.source AS left_split, b.source AS right_split, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2")(lambda s, d: corpus.split_overlap(docs(s, d), "source", T.collapse(F.col("text"))))
query("smp02_srt04_hash_split", "WITH h AS (SELECT DISTINCT o_custkey, sha256('s1|' || CAST(o_custkey AS VARCHAR)) AS h FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY h) AS k, count(*) OVER () AS n FROM h) SELECT o_custkey, k <= round_even(n * 0.1, 0) AS in_sample FROM r")(
    lambda s, d: corpus.hash_split(table(s, d, "orders").select("o_custkey").distinct(), "o_custkey", 0.1, "s1")
)
_R = {"train": 0.65, "layer_discovery": 0.10, "pilot_validation": 0.10, "id_test": 0.15}
_SPLIT = """WITH x AS (SELECT doc_id, lang || '|' || source AS stratum FROM documents), n AS (SELECT stratum, count(*) AS n FROM x GROUP BY 1),
s AS (SELECT stratum, n, unnest([0, 1, 2, 3]) AS i, unnest(['train', 'layer_discovery', 'pilot_validation', 'id_test']) AS name, unnest([0.65::DOUBLE, 0.10, 0.10, 0.15]) AS ratio FROM n),
f AS (SELECT *, n * ratio AS e, floor(n * ratio) AS fl FROM s),
g AS (SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY round(e - fl, 9) DESC, sha256('s2|' || name || '|' || stratum)) <= n - sum(fl) OVER (PARTITION BY stratum) THEN 1 ELSE 0 END AS c FROM f),
u AS (SELECT stratum, i, name, sum(c) OVER (PARTITION BY stratum ORDER BY i) AS hi, sum(c) OVER (PARTITION BY stratum ORDER BY i) - c AS lo FROM g),
p AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s2|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM x)
SELECT p.doc_id, p.stratum, u.name AS split FROM p JOIN u ON p.stratum = u.stratum AND place > lo AND place <= hi"""
query("smp03_stratified_split", _SPLIT)(lambda s, d: corpus.stratified_split(docs(s, d).select("doc_id", "lang", "source"), "doc_id", F.concat_ws("|", "lang", "source"), _R, "s2").select("doc_id", "stratum", "split"))
query("win15_folds", "SELECT o_orderpriority, o_custkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s3|' || o_orderpriority || '|' || CAST(o_custkey AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)")(
    lambda s, d: corpus.folds(table(s, d, "orders"), "o_orderpriority", "o_custkey", 5, "s3")
)
query("smp01_sample_groups", "WITH i AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('s4|' || lang || '|' || source)) AS r FROM (SELECT DISTINCT lang, source FROM documents)) SELECT doc_id FROM documents JOIN i USING (lang, source) WHERE r <= 3")(
    lambda s, d: corpus.sample_groups(docs(s, d), "lang", "source", 3, "s4").select("doc_id")
)
query("smp05_capped_pairs", f"WITH {SQL_EV} SELECT question_uid, p, q FROM (SELECT a.question_uid, a.candidate_index AS p, b.candidate_index AS q, row_number() OVER (PARTITION BY a.question_uid ORDER BY sha256('s5|' || a.question_uid || '|' || a.candidate_index || '|' || b.candidate_index)) AS r FROM v a JOIN v b ON a.question_uid = b.question_uid AND a.label = 1 AND b.label = 0) WHERE r <= 16")(
    lambda s, d: corpus.capped_pairs(views.event_candidates(s, d), 16, "s5")
)
query("smp06_pair_weights", f"WITH {SQL_LI}, p AS (SELECT question_uid % 2 AS dataset, question_uid, sum(label) * sum(1 - label) AS pairs FROM v GROUP BY 1, 2 HAVING sum(label) * sum(1 - label) > 0), w AS (SELECT *, 0.5 / count(*) OVER (PARTITION BY dataset) / pairs AS w FROM p) SELECT dataset, question_uid, CAST(pairs AS BIGINT) AS pairs, round(w / (SELECT sum(w * pairs) / sum(pairs) FROM w), 6) AS weight FROM w")(
    lambda s, d: corpus.pair_weights(views.lineitem_candidates(s, d), F.col("question_uid") % 2)
)
query("smp07_shuffled_epochs", "WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id, unnest(range(0, 3)) AS epoch FROM documents), p AS (SELECT doc_id, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY sha256('s6|' || epoch || '|' || doc_id), doc_id) - 1 AS position FROM e, n) SELECT position, doc_id FROM p, n WHERE position < n * 5 // 2")(
    lambda s, d: (x := docs(s, d).select("doc_id")) and corpus.shuffled_epochs(x, "doc_id", x.count() * 5 // 2, "s6").select(F.col("position").cast("bigint"), "doc_id")
)
query("srt01_srt02_srt03_top_suppliers", "SELECT s_suppkey, round(s_acctbal, 6) AS s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")(lambda s, d: table(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal"))
query("srt06_first_groups_first_rows", f"WITH {SQL_EV}, x AS (SELECT *, dense_rank() OVER (ORDER BY question_uid) AS g FROM v) SELECT question_uid, candidate_index FROM x WHERE g <= 5 AND candidate_index < 4")(
    lambda s, d: (c := views.event_candidates(s, d)) and c.join(F.broadcast(c.select("question_uid").distinct().orderBy("question_uid").limit(5)), "question_uid", "left_semi").where("candidate_index < 4").select("question_uid", "candidate_index")
)
query("srt07_examples_per_category", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")(
    lambda s, d: (w := Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")) and docs(s, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("lang", "doc_id")
)
query("srt08_first_occurrences", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 8 GROUP BY 1")(
    lambda s, d: (w := Window.partitionBy("source").orderBy("doc_id")) and docs(s, d).withColumn("r", F.row_number().over(w)).where("r <= 8").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))
)
_C = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"))
_O = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k"))
query("set01_union_all", "SELECT k, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders) GROUP BY 1")(lambda s, d: _C(s, d).unionByName(_O(s, d)).groupBy("k").agg(F.count("*").alias("n")))
query("set02_union", "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")(lambda s, d: _C(s, d).union(_O(s, d)).distinct())
query("set03_intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")(lambda s, d: _C(s, d).intersect(_O(s, d)))
query("set04_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda s, d: _C(s, d).subtract(_O(s, d)))
query("set06_agg43_overlap_matrix", "WITH e AS (SELECT DISTINCT c_custkey AS k, 'customer' AS name FROM customer UNION SELECT DISTINCT o_custkey, 'orders' FROM orders UNION SELECT DISTINCT s_suppkey, 'supplier' FROM supplier) SELECT x.name AS a, y.name AS b, count(*) AS shared FROM e x JOIN e y USING (k) GROUP BY 1, 2")(
    lambda s, d: corpus.overlap_matrix({"customer": _C(s, d), "orders": _O(s, d), "supplier": table(s, d, "supplier").select("s_suppkey")})
)
query("set07_same_keys", "SELECT count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k")(lambda s, d: corpus.same_keys(_C(s, d), _O(s, d)))
query("snk07_snk08_pending_rows", "SELECT doc_id FROM documents WHERE lang <> 'de'")(lambda s, d: sinks.pending(docs(s, d).select("doc_id"), docs(s, d).where("lang = 'de'"), ["doc_id"]))
query("snk05_snk06_jsn01_record_hash", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS h FROM documents""")(lambda s, d: docs(s, d).select("doc_id", sinks.record_hash(F.col("doc_id"), F.col("lang"), F.col("source")).alias("h")))
query("snk04_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("h")))
query("agg01_agg33_map01_histogram", "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("m")).select("source", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))
)
query("agg02_split_profile", f"WITH {SQL_LI}, q AS (SELECT question_uid, count(*) AS n, sum(label) AS p FROM v GROUP BY 1) SELECT count(*) AS questions, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(n - p) AS BIGINT) AS negative, min(n) AS least, {r('median', places=6).replace('median,', 'median(n),')}, max(n) AS most FROM q")(
    lambda s, d: audit.split_profile(views.lineitem_candidates(s, d))
)
query("agg04_cluster_purity", f"WITH {SQL_EV}, c AS (SELECT question_uid, answer, count(DISTINCT label) AS k FROM v WHERE answer IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT count(*) FILTER (k = 1) AS pure, count(*) FILTER (k > 1) AS mixed, round(count(*) FILTER (k = 1) / greatest(count(*), 1), 6) + 0.0 AS purity FROM c")(
    lambda s, d: audit.cluster_purity(views.event_candidates(s, d), F.col("answer"))
)
