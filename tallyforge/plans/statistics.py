"""Queries of statistics, sequences, vectors, losses, gates, resampling and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, learn, metrics, resample, select, sequences, stats
from ..operators.clusters import cluster_features, cluster_key, clusters, with_z
from ..sources import views
from ..sources.views import SQL_EMB, SQL_EV, SQL_LI, table
from .base import query, r
from .selection import _MAJ, BEST, CL, FEAT, KEY, MODELS, RAW, SEED_SQL, VK, _seeds, top, z

EV, LI = views.event_candidates, views.lineitem_candidates
item = lambda s, d: table(s, d, "lineitem")

query(
    "agg21_describe",
    "SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(median(l_extendedprice), 6) AS median, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS most, round(stddev_pop(l_extendedprice), 6) AS sd, count(DISTINCT l_extendedprice) AS kinds FROM lineitem GROUP BY 1",
)(lambda s, d: stats.describe(item(s, d), "l_extendedprice", "l_returnflag"))
query("agg22_quartiles", "SELECT l_linestatus, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_quantity, {q / 100}), 6) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM lineitem GROUP BY 1")(lambda s, d: stats.quartiles(item(s, d), "l_quantity", "l_linestatus"))
query("agg23_nearest_rank", "SELECT source, n_chars AS value FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS r, round_even((count(*) OVER (PARTITION BY source) - 1) * 0.9, 0) AS a FROM documents) WHERE r = a")(lambda s, d: stats.nearest_rank(table(s, d, "documents"), "n_chars", 0.9, "source"))
_RANK = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
query("win08_average_rank", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round({_RANK('rm', 'question_uid')}, 6) AS rank_rm FROM v")(lambda s, d: stats.with_average_ranks(EV(s, d), ["rm"], "question_uid").select("question_uid", "candidate_index", "rank_rm"))
query("agg24_correlations", f"SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM (SELECT *, {_RANK('l_quantity', 'l_returnflag')} AS a, {_RANK('l_extendedprice', 'l_returnflag')} AS b FROM lineitem) GROUP BY 1")(
    lambda s, d: stats.correlations(item(s, d), "l_quantity", "l_extendedprice", "l_returnflag")
)
query("agg25_within_group_spearman", f"WITH {SQL_EV}, a AS (SELECT *, CAST(candidate_index AS DOUBLE) AS ci FROM v), b AS (SELECT question_uid, corr(x, y) AS c FROM (SELECT question_uid, {_RANK('rm', 'question_uid')} AS x, {_RANK('ci', 'question_uid')} AS y FROM a) GROUP BY 1) SELECT count(c) AS groups, round(avg(c), 6) AS macro FROM b")(
    lambda s, d: stats.correlations(EV(s, d).withColumn("ci", F.col("candidate_index").cast("double")), "rm", "ci", "question_uid").agg(F.count("spearman").alias("groups"), F.avg("spearman").alias("macro"))
)
query("agg26_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")(lambda s, d: stats.ols(item(s, d), "l_quantity", "l_extendedprice").withColumn("intercept", F.round("intercept", 4)))
query("agg27_leave_one_out", "SELECT k.n_nationkey, round(corr(CAST(s.s_acctbal AS DOUBLE), CAST(s.s_suppkey AS DOUBLE)), 6) AS pearson FROM (SELECT DISTINCT s_nationkey AS n_nationkey FROM supplier) k JOIN supplier s ON s.s_nationkey <> k.n_nationkey GROUP BY 1")(
    lambda s, d: stats.leave_one_out(table(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal", F.col("s_suppkey").cast("double").alias("k")), "n_nationkey", "s_acctbal", "k")
)
query("agg28_by_level", "SELECT l_linenumber, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd, min(l_discount) AS least, max(l_discount) AS most FROM lineitem GROUP BY 1")(lambda s, d: stats.by_level(item(s, d), "l_linenumber", "l_discount"))
query("agg29_monotone", "SELECT bool_and(d > 0) AS rising, bool_and(d < 0) AS falling FROM (SELECT m - lag(m) OVER (ORDER BY k) AS d FROM (SELECT l_linenumber AS k, sum(l_quantity) AS m FROM lineitem GROUP BY 1))")(lambda s, d: stats.monotone(item(s, d).groupBy("l_linenumber").agg(F.sum("l_quantity").alias("m")), "l_linenumber", "m"))
query(
    "agg30_mixture_norm",
    "WITH p AS (SELECT l_returnflag, avg(l_discount) AS a, avg(l_discount * l_discount) AS b, avg(ln(1 + l_quantity)) AS c, avg(ln(1 + l_quantity) * ln(1 + l_quantity)) AS e FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT round(avg(a), 6) AS x_mean, round(sqrt(greatest(avg(b) - avg(a) * avg(a), 0)), 6) AS x_std, round(avg(c), 6) AS y_mean, round(sqrt(greatest(avg(e) - avg(c) * avg(c), 0)), 6) AS y_std FROM p",
)(lambda s, d: stats.mixture(item(s, d).where("l_returnflag IN ('A', 'R')").select("l_returnflag", F.col("l_discount").alias("x"), F.log1p("l_quantity").alias("y")), "l_returnflag", ["x", "y"]).select("x_mean", "x_std", "y_mean", "y_std"))
query("agg31_win06_population_stats", "SELECT round(avg(l_discount), 6) AS x_mean, round(stddev_pop(l_discount), 6) AS x_std, round(avg(ln(1 + l_quantity)), 6) AS y_mean, round(stddev_pop(ln(1 + l_quantity)), 6) AS y_std FROM lineitem")(
    lambda s, d: stats.population(item(s, d).select(F.col("l_discount").alias("x"), F.log1p("l_quantity").alias("y")), ["x", "y"])
)
query("agg34_agg35_standard_error", "SELECT l_shipmonth, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS se FROM (SELECT month(l_shipdate) AS l_shipmonth, l_tax AS x FROM lineitem) GROUP BY 1".replace("month(l_shipdate)", "CAST(month(l_shipdate) AS INTEGER)"))(
    lambda s, d: stats.standard_error(item(s, d).select(F.month("l_shipdate").alias("l_shipmonth"), F.col("l_tax").alias("x")), "x", "l_shipmonth")
)
query("agg42_reproduction_error", "SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(avg(abs(x - y)), 6) AS mae, round(median(abs(x - y)), 6) AS median_ae, round(max(abs(x - y)), 6) AS max_ae, round(avg(CASE WHEN sign(x) = sign(y) THEN 1 ELSE 0 END), 6) AS sign_agreement, round(avg(CASE WHEN x = y THEN 1 ELSE 0 END), 6) AS exact FROM (SELECT l_quantity - 25 AS x, CASE WHEN l_linenumber = 1 THEN l_quantity - 25 ELSE l_quantity - 25.5 END AS y FROM lineitem)")(
    lambda s, d: stats.reproduction_error(item(s, d).select((F.col("l_quantity") - 25).alias("x"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity") - 25).otherwise(F.col("l_quantity") - 25.5).alias("y")), "x", "y")
)
query("win02_top_margin", f"WITH {SQL_EV} SELECT question_uid, max(CASE WHEN r = 1 THEN rm END) AS top1, max(CASE WHEN r = 2 THEN rm END) AS top2, round(max(CASE WHEN r = 1 THEN rm END) - max(CASE WHEN r = 2 THEN rm END), 6) + 0.0 AS margin FROM (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS r FROM v) GROUP BY 1")(lambda s, d: sequences.top_margin(EV(s, d)))
query("win07_max_of_others", f"WITH {SQL_LI} SELECT a.question_uid, a.candidate_index, coalesce((SELECT max(rm) FROM v b WHERE b.question_uid = a.question_uid AND b.candidate_index <> a.candidate_index), a.rm) AS max_other FROM v a")(lambda s, d: sequences.max_of_others(LI(s, d)))
query("win06_global_normalisation", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round((rm - (SELECT avg(rm) FROM v)) / greatest((SELECT stddev_pop(rm) FROM v), 1e-6), 6) + 0.0 AS x FROM v")(
    lambda s, d: (c := EV(s, d)) and c.crossJoin(F.broadcast(c.agg(F.avg("rm").alias("m"), F.greatest(F.stddev_pop("rm"), F.lit(1e-6)).alias("sd")))).select("question_uid", "candidate_index", ((F.col("rm") - F.col("m")) / F.col("sd")).alias("x"))
)
query("win10_consecutive_difference", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(lead(rm) OVER (PARTITION BY question_uid ORDER BY candidate_index) - rm, 6) + 0.0 AS change FROM v")(
    lambda s, d: EV(s, d).select("question_uid", "candidate_index", (F.lead("rm").over(sequences.question().orderBy("candidate_index")) - F.col("rm")).alias("change"))
)
query("win11_decayed_change", f"WITH {SQL_EV}, e AS (SELECT question_uid, lead(rm) OVER w - rm AS e, 1 / (1 + exp(-rm / 50)) AS g, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY question_uid) AS n FROM v WINDOW w AS (PARTITION BY question_uid ORDER BY candidate_index)) SELECT question_uid, round(coalesce(sum(pow(0.9, n - 2 - t) * g * e) FILTER (e IS NOT NULL), 0) / (coalesce(sum(pow(0.9, n - 2 - t) * g) FILTER (e IS NOT NULL), 0) + 1e-6), 6) + 0.0 AS reward FROM e GROUP BY 1")(
    lambda s, d: sequences.decayed_change(EV(s, d), "rm", sequences.sigmoid(F.col("rm") / 50), 0.9)
)
query("win12_transition_pooling", f"WITH {SQL_EV}, a AS (SELECT answer, 1 / (1 + exp(-rm / 50)) AS w, rm AS x FROM v), b AS (SELECT answer, sum(w) AS sw, sum(w * x) / greatest(sum(w), 1e-8) AS m FROM a GROUP BY 1) SELECT answer, round(max(m), 5) AS mean, round(sqrt(sum(w * (x - m) * (x - m)) / greatest(max(sw), 1e-8) + 1e-8), 5) AS std FROM a JOIN b USING (answer) GROUP BY 1", places=5)(
    lambda s, d: sequences.transition_pool(EV(s, d), sequences.sigmoid(F.col("rm") / 50), F.col("rm"), "answer")
)
query("win14_tail_mean", "SELECT vec_id, round(list_avg(CAST(embedding[len(embedding) - 7 : len(embedding)] AS DOUBLE[])), 6) + 0.0 AS tail FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", sequences.tail_mean(F.col("embedding").cast("array<double>"), 8).alias("tail")))
query("arr01_arr02_unit_norm_dot", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, list_reverse(v)), 6) + 0.0 AS dot, round(list_cosine_similarity(v, list_reverse(v)), 6) + 0.0 AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", sequences.norm(F.col("v")).alias("norm"), sequences.dot(F.col("v"), F.reverse("v")).alias("dot"), sequences.cosine(F.col("v"), F.reverse("v")).alias("cosine"))
)
query("arr03_elementwise_mean", "SELECT vec_id, round((v[1] + v[64]) / 2, 6) + 0.0 AS first, round((v[2] + v[63]) / 2, 6) + 0.0 AS second FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", sequences.mean_of(F.col("embedding").cast("array<double>"), F.reverse(F.col("embedding").cast("array<double>"))).alias("m")).select("vec_id", F.get("m", F.lit(0)).alias("first"), F.get("m", F.lit(1)).alias("second"))
)
query("arr04_arr05_array_index", "SELECT doc_id, list_position(['en', 'fr', 'de', 'es'], lang) - 1 AS place, len(list_distinct(string_split(source, 's'))) = len(string_split(source, 's')) AS distinct_parts FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", (F.array_position(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.col("lang")).cast("int") - 1).alias("place"), (F.size(F.array_distinct(F.split("source", "s"))) == F.size(F.split("source", "s"))).alias("distinct_parts"))
)
query("arr06_linear_probe", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x - m) / sqrt(s + 1e-5))) * 0.5 + 0.1, 6) + 0.0 AS probe FROM (SELECT vec_id, v, list_avg(v) AS m, list_var_pop(v) AS s FROM (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS v FROM embeddings))".replace("list_var_pop(v)", "list_aggregate(v, 'var_pop')"), places=5)(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("v")).select("vec_id", "v", (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 8).alias("m"))
    .select("vec_id", "v", "m", (F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / 8).alias("s")).select("vec_id", (F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) / F.sqrt(F.col("s") + 1e-5)) * 0.5 + 0.1).alias("probe"))
)
query(
    "agg09_vector_cohesion",
    f"""WITH {SQL_EMB}, u AS (SELECT question_uid, {KEY} AS cluster, i, v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-8) AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM v)),
o AS (SELECT question_uid, cluster, i, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2, 3), p AS (SELECT *, sum(s) OVER (PARTITION BY question_uid, i) - s AS o FROM o),
c AS (SELECT question_uid, cluster, max(n) AS n, sum(s * s) AS ss, sum(o * o) AS oo, sum(s * o) AS so FROM p GROUP BY 1, 2)
SELECT question_uid, cluster, n, round(sqrt(ss) / n, 6) AS centroid_norm, round(CASE WHEN n > 1 THEN (ss - n) / (n * (n - 1)) ELSE 1.0 END, 6) + 0.0 AS pair_cosine, round(CASE WHEN oo > 1e-16 THEN 1 - so / (sqrt(ss) * sqrt(oo)) END, 6) + 0.0 AS separation FROM c""",
)(lambda s, d: sequences.vector_cohesion(views.vector_candidates(s, d)))
query("agg10_prompt_agreement", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS agreement FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda s, d: (e := table(s, d, "embeddings")) and e.select("vec_id", F.col("embedding").cast("array<double>").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b")), "vec_id").select("vec_id", sequences.cosine(F.col("a"), F.col("b")).alias("agreement"))
)
_ZN = f"({z('(SELECT *, rm * 0.01 AS nm, rm * 0.02 + candidate_index % 3 AS nl FROM v)', 'nm', 'zm')})"
query("agg08_nll_features", f"WITH {SQL_EV} SELECT question_uid, {KEY} AS cluster, round(-avg(zm), 6) + 0.0 AS nll_mean, round(-min(zm), 6) + 0.0 AS nll_best, round(-avg(zl), 6) + 0.0 AS nll_last FROM ({z(_ZN, 'nl', 'zl')}) GROUP BY 1, 2")(
    lambda s, d: sequences.nll_features(EV(s, d).withColumns({"nm": F.col("rm") * 0.01, "nl": F.col("rm") * 0.02 + F.col("candidate_index") % 3}), "nm", "nl")
)
query(
    "agg41_support_entropy",
    f"""WITH {SQL_EV}, c AS (SELECT question_uid, {KEY} AS cluster, count(*) AS n FROM v GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY question_uid) AS p, row_number() OVER (PARTITION BY question_uid ORDER BY n DESC, cluster) AS r FROM c)
SELECT question_uid, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(greatest(p, 1e-12))) / ln(greatest(count(*), 2)) ELSE 0.0 END, 6) + 0.0 AS entropy, round(CASE WHEN count(*) > 1 THEN max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END) ELSE 1.0 END, 6) + 0.0 AS support_margin FROM p GROUP BY 1""",
)(lambda s, d: sequences.support_entropy(EV(s, d)))
query("mth01_scalar_math", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(ln(1 + abs(rm)), 6) AS log1p, round(exp(-abs(rm) / 100), 6) AS e, round(1 / (1 + exp(-greatest(least(rm, 40.0), -40.0))), 6) AS sig FROM v")(
    lambda s, d: EV(s, d).select("question_uid", "candidate_index", F.log1p(F.abs("rm")).alias("log1p"), F.exp(-F.abs("rm") / 100).alias("e"), sequences.sigmoid(F.col("rm")).alias("sig"))
)
query(
    "mth02_ranking_losses",
    f"""WITH {SQL_EV}, s AS (SELECT *, rm / 50 AS sc FROM v), l AS (SELECT question_uid, ln(sum(exp(sc))) - ln(sum(exp(sc)) FILTER (label = 1)) AS listwise FROM s GROUP BY 1),
p AS (SELECT a.question_uid, avg(ln(1 + exp(-(a.sc - b.sc)))) AS bt, avg(pow(1 / (1 + exp(-(a.sc - b.sc))) - 1, 2)) AS brier FROM s a JOIN s b ON a.question_uid = b.question_uid AND a.label = 1 AND b.label = 0 GROUP BY 1)
SELECT question_uid, {r("listwise", "bt", "brier")} FROM l JOIN p USING (question_uid)""",
)(lambda s, d: sequences.ranking_losses(EV(s, d).withColumn("score", F.col("rm") / 50)))
query(
    "mth03_damage_losses",
    f"""WITH {SQL_EV}, s AS (SELECT *, rm * 0.9 + 0.1 * (candidate_index % 7) AS sc, row_number() OVER (PARTITION BY question_uid {BEST}) AS r FROM v),
g AS (SELECT question_uid, max(CASE WHEN r = 1 THEN label END) AS ok, max(CASE WHEN r = 1 THEN sc END) AS t, max(CASE WHEN label = 0 THEN sc END) AS neg, max(CASE WHEN label = 1 THEN sc END) AS pos, max(CASE WHEN r = 1 THEN rm END) - max(CASE WHEN r = 2 THEN rm END) AS m, avg(CASE WHEN abs(sc - rm) < 1 THEN 0.5 * (sc - rm) * (sc - rm) ELSE abs(sc - rm) - 0.5 END) AS sm FROM s GROUP BY 1)
SELECT question_uid, round(CASE WHEN ok = 1 THEN greatest(neg - t + 0.1, 0) + ln(1 + exp(-abs(neg - t + 0.1))) ELSE 0 END, 6) + 0.0 AS protect, round(CASE WHEN ok = 1 THEN 0 ELSE greatest(t - pos + 0.1, 0) + ln(1 + exp(-abs(t - pos + 0.1))) END, 6) + 0.0 AS correct, round(CASE WHEN ok = 1 THEN 1 + 1 / (1 + exp(-greatest(least(m, 40), -40))) ELSE 0.25 END * sm, 6) + 0.0 AS anchor FROM g WHERE pos IS NOT NULL AND neg IS NOT NULL""",
)(lambda s, d: sequences.damage_losses(EV(s, d).withColumn("score", F.col("rm") * 0.9 + 0.1 * (F.col("candidate_index") % 7))))
query("mth04_binomial", "SELECT n_nationkey, round(list_product(list_transform(range(1, 4), lambda i: (n_nationkey + 5 - 3 + i) / i)), 6) AS c3 FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", sequences.binomial(F.col("n_nationkey") + 5, 3).alias("c3")))
query("mth05_p_true", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(1 / (1 + exp(0.2 - rm / 30)), 6) AS p, round(rm / 30 - 0.2, 6) + 0.0 AS margin FROM v")(
    lambda s, d: EV(s, d).select("question_uid", "candidate_index", sequences.p_true(F.col("rm") / 30, F.lit(0.2)).alias("p"), (F.col("rm") / 30 - 0.2).alias("margin"))
)
# Judges, two score models, and the questions whose choice changes between raw score and majority by count.
_NEW = top("cl", "n DESC, rm_max DESC, first_index")
_CH = f"""{RAW}, {CL}, vk AS (SELECT *, {KEY} AS cluster FROM v), nw AS (SELECT vk.*, row_number() OVER (PARTITION BY vk.question_uid {BEST}) AS k FROM vk JOIN {_NEW} p ON vk.question_uid = p.question_uid AND vk.cluster = p.cluster),
ch AS (SELECT raw.question_uid, raw.label AS raw_right, nw.label AS new_right, CAST(raw.solution AS BIGINT) AS rs, CAST(nw.solution AS BIGINT) AS ns FROM raw JOIN nw ON raw.question_uid = nw.question_uid AND nw.k = 1 WHERE raw.candidate_index <> nw.candidate_index)"""


def _changed(s, d):
    from ..operators.clusters import raw_choice

    c = EV(s, d)
    raw = raw_choice(c).select("question_uid", F.col("candidate_index").alias("ri"), F.col("label").alias("raw_right"), F.col("solution").cast("bigint").alias("rs"))
    new = select.majority_count(c).select("question_uid", F.col("candidate_index").alias("ni"), F.col("label").alias("new_right"))
    sol = c.select("question_uid", F.col("candidate_index").alias("ni"), F.col("solution").cast("bigint").alias("ns"))
    return raw.join(new, "question_uid").join(sol, ["question_uid", "ni"]).where("ri <> ni")


query("agg39_jn17_judge_preference", f"WITH {SQL_EV}, {_CH}, j AS (SELECT *, ns % 97 - rs % 97 AS d FROM ch) SELECT count(*) AS changed, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, count(*) FILTER (raw_right <> new_right) AS label_changes, count(*) FILTER ((d > 0 AND new_right > raw_right) OR (d < 0 AND new_right < raw_right)) AS aligned FROM j")(
    lambda s, d: metrics.judge_preference(_changed(s, d), (F.col("rs") % 97).cast("double"), (F.col("ns") % 97).cast("double"))
)
query("agg40_judge_consensus", f"WITH {SQL_EV}, {_CH}, j AS (SELECT sign(ns % 97 - rs % 97) + sign(ns % 89 - rs % 89) + sign(ns % 83 - rs % 83) AS v FROM ch) SELECT count(*) AS changed, count(*) FILTER (v > 0) AS prefer_new, count(*) FILTER (v < 0) AS prefer_raw, count(*) FILTER (v = 0) AS split, count(*) FILTER (abs(v) = 3) AS unanimous FROM j")(
    lambda s, d: metrics.judge_consensus(_changed(s, d), [((F.col("rs") % m).cast("double"), (F.col("ns") % m).cast("double")) for m in (97, 89, 83)])
)
query("agg38_jn16_complementarity", f"WITH {SQL_EV}, a AS (SELECT *, {SEED_SQL} FROM v), b AS (SELECT question_uid, max(CASE WHEN x = 1 THEN label END) AS p, max(CASE WHEN y = 1 THEN label END) AS q FROM (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS x, row_number() OVER (PARTITION BY question_uid ORDER BY s2 DESC, candidate_index) AS y FROM a) GROUP BY 1) SELECT count(*) FILTER (p = 1 AND q = 1) AS stay_right, count(*) FILTER (p = 0 AND q = 0) AS stay_wrong, count(*) FILTER (p = 1 AND q = 0) AS damaged, count(*) FILTER (p = 0 AND q = 1) AS corrected FROM b")(
    lambda s, d: metrics.transition(metrics.question_outcomes(_seeds(EV(s, d)), "s2"), F.col("raw_right"), F.col("new_right"))
)
query("jn10_cluster_pairs", f"WITH {SQL_LI}, {CL} SELECT a.question_uid, count(*) AS pairs, count(*) FILTER (a.rm_max > b.rm_max) AS ordered FROM cl a JOIN cl b ON a.question_uid = b.question_uid AND a.label_share >= 0.5 AND b.label_share < 0.5 GROUP BY 1")(
    lambda s, d: (c := clusters(LI(s, d))) and c.where("label_share >= 0.5").select("question_uid", F.col("rm_max").alias("p")).join(c.where("label_share < 0.5").select("question_uid", F.col("rm_max").alias("q")), "question_uid").groupBy("question_uid").agg(F.count("*").alias("pairs"), F.count_if(F.col("p") > F.col("q")).alias("ordered"))
)
query("win05_degradation_standardize", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(CASE WHEN stddev_pop(rm) OVER w < 1e-12 THEN 0 ELSE (rm - avg(rm) OVER w) / stddev_pop(rm) OVER w END, 6) + 0.0 AS z FROM v WINDOW w AS (PARTITION BY question_uid)")(lambda s, d: with_z(EV(s, d), least=1e-12).select("question_uid", "candidate_index", "z"))
_U = lambda t: f"(CAST('0x' || substr(sha256('7{t}|' || question_uid || '|' || candidate_index), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
query("smp08_degradation_noise", f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(CASE WHEN stddev_pop(rm) OVER w < 1e-12 THEN 0 ELSE (rm - avg(rm) OVER w) / stddev_pop(rm) OVER w END + 0.5 * sqrt(-2 * ln({_U('a')})) * cos(2 * pi() * {_U('b')}), 6) + 0.0 AS noisy FROM v WINDOW w AS (PARTITION BY question_uid)")(
    lambda s, d: resample.group_noise(EV(s, d), 0.5, 7).select("question_uid", "candidate_index", "noisy")
)


def _gate_table(s, d):
    i = F.col("candidate_index")
    c = EV(s, d).withColumns({"s1": F.col("rm") * 0.9 + 0.01 * (i % 7), "s2": F.col("rm") * 1.1 - 0.02 * (i % 5), "s3": F.col("rm") + 4.0 * (i % 3)}).withColumns({"a1": F.lit(0.5), "a2": (F.col("candidate_index") % 5) / 5, "chunks": F.col("candidate_index") % 9, "length": F.col("candidate_index") * 3 + 10})
    return gates.switch_features(c, ["s1", "s2", "s3"], ["a1", "a2"], 3.0, "chunks", "length")


def _both(*xs: str) -> tuple[str, str]:
    """Mean and population deviation of expressions, as SQL."""
    m = f"(({' + '.join(xs)}) / {len(xs)})"
    return m, f"sqrt(greatest(({' + '.join(f'pow({x} - {m}, 2)' for x in xs)}) / {len(xs)}, 0))"


_GAP, _GAP_SD = _both(*[f"(pd{i} - rd{i})" for i in (1, 2, 3)])
_RA, _RA_SD = _both("ra1", "ra2")
_PA, _PA_SD = _both("pa1", "pa2")
_PICKS = ", ".join(f"max(CASE WHEN {place} = 1 THEN {x} END) AS {p}{n}" for place, p in (("r", "r"), ("p", "p")) for n, x in (("d1", "d1"), ("d2", "d2"), ("d3", "d3"), ("a1", "a1"), ("a2", "a2"), ("c", "chunks"), ("l", "length"), ("_rm", "rm"), ("_blend", "blend"), ("_i", "candidate_index"), ("_ok", "label")))
_GATE_FEATURES = {
    "raw_margin": "r_rm - r2_rm", "raw_rm": "r_rm", "prop_rm": "p_rm", "rm_sd": "rm_sd", "log_n": "ln(1 + n)", "proposed_margin": "p_blend - r_blend", "gap_mean": _GAP, "gap_sd": _GAP_SD,
    "agreement": "((t1 = p_i)::INT + (t2 = p_i)::INT + (t3 = p_i)::INT) / 3", "switch_rate": "((t1 <> r_i)::INT + (t2 <> r_i)::INT + (t3 <> r_i)::INT) / 3",
    "alpha_raw": _RA, "alpha_raw_sd": _RA_SD, "alpha_prop": _PA, "alpha_prop_sd": _PA_SD, "log_chunks": "ln(1 + rc)", "log_chunks_gain": "ln(1 + pc) - ln(1 + rc)",
    "log_length": "ln(1 + rl)", "log_length_gain": "ln(1 + pl) - ln(1 + rl)", "sd_mean": "sd_mean", "md_sd": "md_sd", "beta": "3.0",
}
_GC = list(_GATE_FEATURES)
_GF = f"""WITH {SQL_EV}, a AS (SELECT *, {SEED_SQL.replace('0.03', '4.0')}, 0.5::DOUBLE AS a1, (candidate_index % 5) / 5.0::DOUBLE AS a2, candidate_index % 9 AS chunks, candidate_index * 3 + 10 AS length FROM v),
b AS (SELECT *, s1 - rm AS d1, s2 - rm AS d2, s3 - rm AS d3 FROM a), c AS (SELECT *, (d1 + d2 + d3) / 3 AS md FROM b),
e AS (SELECT *, sqrt((pow(d1 - md, 2) + pow(d2 - md, 2) + pow(d3 - md, 2)) / 3) AS sd, round(rm + 3.0 * md, 9) AS blend FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS r, row_number() OVER (PARTITION BY question_uid ORDER BY blend DESC, candidate_index) AS p,
  {", ".join(f"row_number() OVER (PARTITION BY question_uid ORDER BY round(rm + 3.0 * d{i}, 9) DESC, candidate_index) AS o{i}" for i in (1, 2, 3))} FROM e),
q AS (SELECT question_uid, count(*) AS n, stddev_pop(rm) AS rm_sd, avg(sd) AS sd_mean, stddev_pop(md) AS md_sd, max(CASE WHEN r = 2 THEN rm END) AS r2_rm, {_PICKS},
  {", ".join(f"max(CASE WHEN o{i} = 1 THEN candidate_index END) AS t{i}" for i in (1, 2, 3))} FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT question_uid, {", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in _GATE_FEATURES.items())}, r_i <> p_i AS switch, p_ok - r_ok AS target FROM q"""
query("sel25_gate_features", _GF)(_gate_table)
query("sel24_lrn08_utility_gate")(lambda s, d: (t := _gate_table(s, d)) and t.withColumn("utility", gates.utility(_GC, gates.fit_utility_gate(t, _GC))).select("question_uid", "switch", "target", "utility"))
query("sel26_crossfit_gate")(lambda s, d: gates.crossfit_utility(_gate_table(s, d), _GC, 5).select("question_uid", "fold", "utility"))
_D = "SELECT question_uid, avg(rm) AS m, stddev_pop(rm) AS sd, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1"
_OZ = " + ".join(f"pow(greatest(least(({c} - (SELECT quantile_cont({c}, 0.5) FROM x)) / ((SELECT quantile_cont({c}, 0.9) FROM x) - (SELECT quantile_cont({c}, 0.1) FROM x)), 10), -10), 2)" for c in ("m", "sd", "n"))
query("sel27_ood_distance", f"WITH {SQL_EV}, x AS ({_D}) SELECT question_uid, round(sqrt(({_OZ}) / 3), 6) AS distance FROM x")(
    lambda s, d: (x := EV(s, d).groupBy("question_uid").agg(F.avg("rm").alias("m"), F.stddev_pop("rm").alias("sd"), F.count("*").cast("double").alias("n"))) and gates.ood_distance(x, x, ["m", "sd", "n"], "question_uid")
)


def _reliability(s, d):
    from .selection import MODELS as models

    c = EV(s, d)
    f = select.linear_scores(cluster_features(c), models).join(clusters(c).select("question_uid", "cluster", "rm_max", "n"), ["question_uid", "cluster"])
    for i, m in enumerate(models):
        f = with_z(f.withColumn(f"x{i}", gates.model_margin(m)), f"x{i}", f"m{i}").drop(f"x{i}")
    f = with_z(with_z(f, "rm_max", "rm_z"), "learned", "learned_z").withColumn("hybrid", F.round(F.col("rm_z") + 0.5 * F.col("learned_z"), 9))
    w = sequences.question().orderBy(F.desc("hybrid"), "first_index")
    f = f.withColumn("is_proposal", F.row_number().over(w) == 1).withColumn("is_raw", F.col("has_raw") == 1)
    return gates.reliability_features(f.select("question_uid", "cluster", "n", "rm_z", "learned_z", "hybrid", "is_raw", "is_proposal", "m0", "m1", "m2"))


_RELIABLE = {
    "raw_lead": "raw_z - coalesce(rest_rm, raw_z)", "hybrid_gain": "prop_h - raw_h", "hybrid_lead": "prop_h - coalesce(rest_h, prop_h)", "learned_gain": "prop_l - raw_l", "rm_gain": "prop_z - raw_z",
    "p_share": "p_share", "r_share": "r_share", "share_gain": "p_share - r_share", "most": "most", "support_margin": "CASE WHEN k = 1 THEN 1 ELSE shares[1] - shares[2] END", "entropy": "CASE WHEN k = 1 THEN 0 ELSE h / ln(k) END",
    "raw_is_most": "(r_share = most)::DOUBLE", "prop_is_most": "(p_share = most)::DOUBLE", "log_k": "ln(1 + k)", "model_spread": _both(*[f"(pm{i} - rm{i})" for i in range(3)])[1],
}
_RC = list(_RELIABLE)


def _reliable_sql() -> str:
    """Clusters with z of their best reward, of the ensemble and of each model alone; then one row for each question."""
    from .selection import MODELS as models

    of = lambda flag, x: f"max(CASE WHEN {flag} THEN {x} END)"
    single = ", ".join(f"{' + '.join(f'({w!r}) * {c}' for w, c in zip(m, select.FEATURES, strict=True))} AS x{i}" for i, m in enumerate(models))
    steps, last = [f"y0 AS (SELECT *, {single} FROM ln1)", "y1 AS (SELECT y0.*, n FROM y0 JOIN (SELECT question_uid, cluster, count(*) AS n FROM vk GROUP BY 1, 2) USING (question_uid, cluster))"], "y1"
    for i, (x, out) in enumerate([("rm_max", "rm_z"), ("learned", "learned_z"), ("x0", "m0"), ("x1", "m1"), ("x2", "m2")]):
        steps.append(f"y{i + 2} AS ({z(last, x, out)})")
        last = f"y{i + 2}"
    return f"""{VK}, {FEAT}, {", ".join(steps)}, w0 AS (SELECT *, round(rm_z + 0.5 * learned_z, 9) AS hybrid, n / sum(n) OVER (PARTITION BY question_uid) AS share, has_raw = 1 AS is_raw FROM {last}),
w1 AS (SELECT *, row_number() OVER (PARTITION BY question_uid ORDER BY hybrid DESC, first_index) = 1 AS is_prop FROM w0),
w2 AS (SELECT question_uid, count(*) AS k, -sum(share * ln(greatest(share, 1e-12))) AS h, max(share) AS most, list(share ORDER BY share DESC) AS shares, {of("is_raw", "rm_z")} AS raw_z, {of("NOT is_raw", "rm_z")} AS rest_rm, {of("is_prop", "rm_z")} AS prop_z,
  {of("is_prop", "hybrid")} AS prop_h, {of("is_raw", "hybrid")} AS raw_h, {of("NOT is_prop", "hybrid")} AS rest_h, {of("is_prop", "learned_z")} AS prop_l, {of("is_raw", "learned_z")} AS raw_l, {of("is_prop", "share")} AS p_share, {of("is_raw", "share")} AS r_share,
  {", ".join(f"{of('is_prop', f'm{i}')} AS pm{i}, {of('is_raw', f'm{i}')} AS rm{i}" for i in range(3))} FROM w1 GROUP BY 1)
SELECT question_uid, {", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in _RELIABLE.items())} FROM w2"""


query("sel29_reliability_features", f"WITH {SQL_EV}, {_reliable_sql()}")(_reliability)


@query("sel29_reliability_gate")
def reliability_gate(s, d):
    """Probability of harm of each proposed switch, by all 15 features, fitted on all questions."""
    harm = _changed(s, d).select("question_uid", (F.col("raw_right") > F.col("new_right")).cast("int").alias("harm"))
    x = _reliability(s, d).join(harm, "question_uid")
    ((model,),) = gates.fit_gates(x, _RC, [(F.col("harm"), F.lit(1.0))])
    return x.select("question_uid", gates.logistic(_RC, model).alias("p_harm"))


_GRID = [0.0, 0.5, 1.0]
_CAPS = [0.5, 1.0, 2.0]
query("sel31_cap_sweep", f"WITH {SQL_EV}, e AS (SELECT *, round(rm + cap * (exp(2 * sin(candidate_index)) - 1) / (exp(2 * sin(candidate_index)) + 1), 9) AS sc FROM v, (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS cap)), k AS (SELECT *, row_number() OVER (PARTITION BY cap, question_uid ORDER BY sc DESC, candidate_index) AS r FROM e) SELECT cap, round(avg(label), 6) AS top1 FROM k WHERE r = 1 GROUP BY 1")(
    lambda s, d: (w := sequences.Window.partitionBy("cap", "question_uid").orderBy(F.desc("sc"), "candidate_index")) and EV(s, d).withColumn("cap", F.explode(F.array(*map(F.lit, _CAPS)))).withColumn("sc", F.round(F.col("rm") + F.col("cap") * F.tanh(F.sin(F.col("candidate_index").cast("double"))), 9)).withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("cap").agg(F.avg("label").alias("top1"))
)
query("sel23_beta_curve", f"WITH {SQL_EV}, e AS (SELECT *, round(rm + beta * (s2 - rm), 9) AS sc FROM (SELECT *, {SEED_SQL} FROM v), (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS beta)), k AS (SELECT *, row_number() OVER (PARTITION BY beta, question_uid ORDER BY sc DESC, candidate_index) AS r FROM e) SELECT beta, round(avg(label), 6) AS top1 FROM k WHERE r = 1 GROUP BY 1")(
    lambda s, d: (w := sequences.Window.partitionBy("beta", "question_uid").orderBy(F.desc("sc"), "candidate_index")) and _seeds(EV(s, d)).withColumn("beta", F.explode(F.array(*map(F.lit, _GRID)))).withColumn("sc", F.round(F.col("rm") + F.col("beta") * (F.col("s2") - F.col("rm")), 9)).withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("beta").agg(F.avg("label").alias("top1"))
)
_REGS = {0.001: MODELS, 0.01: [MODELS[0]] * 3, 0.1: [MODELS[1]] * 3, 1.0: [MODELS[2]] * 3, 10.0: [[w * 0.1 for w in MODELS[0]]] * 3}


_BETAS, _GATES = [0.0, 0.25, 0.5, 1.0, 2.0], [0.0, 0.1, 0.25, 0.5]
_BY_REG = " ".join(f"WHEN reg = {x!r} THEN " + " + ".join(f"({sum(m[i] for m in models) / len(models)!r}) * {c}" for i, c in enumerate(select.FEATURES)) for x, models in _REGS.items())
_OWN = "PARTITION BY question_uid, reg, beta"
_GRID_SQL = f"""{SQL_LI}, {VK}, {RAW}, {FEAT},
gl AS (SELECT *, CASE {_BY_REG} END AS learned FROM ft, (SELECT unnest({sorted(_REGS)}::DOUBLE[]) AS reg)),
gm AS (SELECT *, avg(rm_max) OVER w AS mr, stddev_pop(rm_max) OVER w AS sr, avg(learned) OVER w AS ml, stddev_pop(learned) OVER w AS sl FROM gl WINDOW w AS (PARTITION BY reg, question_uid)),
gs AS (SELECT question_uid, cluster, first_index, reg, beta, round(CASE WHEN sr < 1e-6 THEN 0 ELSE (rm_max - mr) / nullif(sr, 0) END + beta * CASE WHEN sl < 1e-6 THEN 0 ELSE (learned - ml) / nullif(sl, 0) END, 9) AS s FROM gm, (SELECT unnest({_BETAS}::DOUBLE[]) AS beta)),
g1 AS (SELECT gs.*, raw.cluster AS rawc FROM gs JOIN raw USING (question_uid)),
g2 AS (SELECT *, max(s) OVER ({_OWN}) AS t, max(CASE WHEN cluster = rawc THEN s END) OVER ({_OWN}) AS rs, row_number() OVER ({_OWN} ORDER BY s DESC, first_index) AS place FROM g1),
g3 AS (SELECT *, max(CASE WHEN place = 1 AND cluster = rawc THEN 1 ELSE 0 END) OVER ({_OWN}) AS same FROM g2),
gx AS (SELECT x.question_uid, x.candidate_index, x.label, x.rm, reg, beta, held, same, t - rs AS lead, round(CASE WHEN held = 1 AND g3.cluster = rawc THEN t + 1e-4 ELSE s END + 1e-4 * rel, 9) AS score
  FROM ({z("vk", "rm", "rel")}) x JOIN g3 ON x.question_uid = g3.question_uid AND x.cluster = g3.cluster, (SELECT unnest([0, 1]) AS held)),
go0 AS (SELECT *, row_number() OVER ({_OWN}, held {BEST}) AS a, row_number() OVER ({_OWN}, held ORDER BY score DESC, candidate_index) AS b FROM gx),
go1 AS (SELECT question_uid, reg, beta, held, any_value(same) AS same, any_value(lead) AS lead, max(CASE WHEN a = 1 THEN label END) AS raw_right, max(CASE WHEN b = 1 THEN label END) AS new_right, max(CASE WHEN a = 1 AND b <> 1 THEN 1 ELSE 0 END) AS switched FROM go0 GROUP BY ALL),
go2 AS (SELECT x.question_uid, x.reg, x.beta, x.held, avg(CASE WHEN x.score > y.score THEN 1.0 ELSE 0.0 END) AS strict FROM gx x JOIN gx y ON x.question_uid = y.question_uid AND x.reg = y.reg AND x.beta = y.beta AND x.held = y.held AND x.label = 1 AND y.label = 0 GROUP BY 1, 2, 3, 4),
gg AS (SELECT reg, beta, threshold, avg(new_right) AS top1, avg(strict) AS pair_macro_strict, sum(raw_right * (1 - new_right)) / greatest(sum(raw_right), 1) AS damage_rate, avg(switched) AS switch_rate
  FROM go1 LEFT JOIN go2 USING (question_uid, reg, beta, held), (SELECT unnest({_GATES}::DOUBLE[]) AS threshold) WHERE held = CASE WHEN same = 0 AND lead <= threshold THEN 1 ELSE 0 END GROUP BY 1, 2, 3),
gc AS (SELECT *, least > 0.03 AS fallback FROM (SELECT *, min(damage_rate) OVER () AS least FROM gg) WHERE damage_rate <= 0.03 OR (least > 0.03 AND damage_rate = least)
  ORDER BY round(top1, 9) DESC, round(pair_macro_strict, 9) DESC, round(damage_rate, 9), round(switch_rate, 9), reg, beta, threshold LIMIT 1)"""
_GRID_COLUMNS = f"reg, beta, threshold, {r('top1', 'pair_macro_strict', 'damage_rate', 'switch_rate')}"
_grid = lambda s, d: learn.grid(LI(s, d), _REGS, _BETAS, _GATES)
query("sel17_config_grid_100", f"WITH {_GRID_SQL} SELECT {_GRID_COLUMNS} FROM gg")(_grid)
query("sel17_config_choice", f"WITH {_GRID_SQL} SELECT {_GRID_COLUMNS}, fallback FROM gc")(lambda s, d: learn.choose(_grid(s, d)))
query("sel20_grid_verification", f"WITH {_GRID_SQL} SELECT count(*) = 1 AS verified FROM gc")(lambda s, d: (g := _grid(s, d)) and learn.verify_choice(g, learn.choose(g)))
_TAU, _THR = [1.0, 2.0, 4.0, 8.0, 16.0], [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0]


_WGRID = f"""{SQL_EV}, vk AS (SELECT *, {KEY} AS cluster FROM v), t AS (SELECT vk.*, tau FROM vk, (SELECT unnest({_TAU}::DOUBLE[]) AS tau)),
w AS (SELECT *, max(rm / tau) OVER (PARTITION BY tau, question_uid, cluster) AS t, row_number() OVER (PARTITION BY tau, question_uid, cluster {BEST}) AS k, row_number() OVER (PARTITION BY tau, question_uid {BEST}) AS a FROM t),
m AS (SELECT tau, question_uid, cluster, round(max(t) + ln(sum(exp(rm / tau - t))), 9) AS mass, min(candidate_index) AS fi, max(CASE WHEN k = 1 THEN label END) AS label, max(CASE WHEN a = 1 THEN 1 ELSE 0 END) AS raw FROM w GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY tau, question_uid ORDER BY mass DESC, fi) AS r, max(CASE WHEN raw = 1 THEN mass END) OVER (PARTITION BY tau, question_uid) AS rmass, max(CASE WHEN raw = 1 THEN label END) OVER (PARTITION BY tau, question_uid) AS rl FROM m),
p AS (SELECT *, raw = 0 AND mass - rmass > threshold AS moved FROM n, (SELECT unnest({_THR}::DOUBLE[]) AS threshold) WHERE r = 1),
q AS (SELECT *, CASE WHEN moved THEN label ELSE rl END AS hit FROM p),
wg AS (SELECT tau, threshold, avg(hit) AS top1, sum(rl * (1 - hit)) / greatest(sum(rl), 1) AS damage_rate, sum((1 - rl) * hit) / greatest(sum(1 - rl), 1) AS correction_rate, avg(moved::INT) AS switch_rate FROM q GROUP BY 1, 2)"""
_WCOLS = f"tau, threshold, {r('top1', 'damage_rate', 'correction_rate', 'switch_rate')}"
query("sel18_weighted_grid", f"WITH {_WGRID} SELECT {_WCOLS} FROM wg")(lambda s, d: select.weighted_grid(EV(s, d), _TAU, _THR))
query("sel18_weighted_choice", f"WITH {_WGRID} SELECT {_WCOLS} FROM wg WHERE round(top1, 9) >= (SELECT max(round(top1, 9)) FROM wg) - 0.005 ORDER BY round(damage_rate, 9), round(top1, 9) DESC, round(switch_rate, 9), tau, threshold LIMIT 1")(lambda s, d: select.within_band(select.weighted_grid(EV(s, d), _TAU, _THR)))
query("sel19_temperature_choice", f"""WITH {SQL_EV}, vk AS (SELECT *, {KEY} AS cluster, exp(-abs(rm) / 100) AS c FROM v), t AS (SELECT vk.*, temp, max(c) OVER (PARTITION BY question_uid) AS m FROM vk, (SELECT unnest([0.1, 0.5, 1.0, 2.0]::DOUBLE[]) AS temp)),
k AS (SELECT temp, question_uid, cluster, round(sum(exp((c - m) / temp)), 9) AS mass, max(rm) AS rm_max, min(candidate_index) AS fi, arg_max(label, (rm, -candidate_index)) AS label FROM t GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY temp, question_uid ORDER BY mass DESC, rm_max DESC, fi) AS r FROM k)
SELECT temp, round(top1, 6) AS top1 FROM (SELECT temp, avg(label) AS top1 FROM n WHERE r = 1 GROUP BY 1) ORDER BY round(top1, 9) DESC, temp DESC LIMIT 1""")(
    lambda s, d: EV(s, d).withColumns({"cluster": cluster_key(), "c": F.exp(-F.abs("rm") / 100)}).withColumn("m", F.max("c").over(sequences.question())).withColumn("temp", F.explode(F.array(*map(F.lit, [0.1, 0.5, 1.0, 2.0]))))
    .groupBy("temp", "question_uid", "cluster").agg(F.round(F.sum(F.exp((F.col("c") - F.col("m")) / F.col("temp"))), 9).alias("mass"), F.max("rm").alias("rm_max"), F.min("candidate_index").alias("fi"), F.max_by("label", F.struct("rm", -F.col("candidate_index"))).alias("label"))
    .withColumn("r", F.row_number().over(sequences.Window.partitionBy("temp", "question_uid").orderBy(F.desc("mass"), F.desc("rm_max"), "fi"))).where("r = 1").groupBy("temp").agg(F.avg("label").alias("top1")).orderBy(F.desc(F.round("top1", 9)), F.desc("temp")).limit(1)
)
query("sel32_layer_selection", "WITH g AS (SELECT l_linenumber AS layer, avg(m - b) AS gain, min(m - b) AS worst FROM (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_returnflag, avg(l_quantity) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) USING (l_returnflag) GROUP BY 1) SELECT layer, round(gain, 6) AS gain, round(worst, 6) AS worst FROM g WHERE gain > -5 AND worst >= -9 ORDER BY round(gain, 9) DESC, layer LIMIT 1")(
    lambda s, d: learn.guarded_layer(item(s, d).groupBy(F.col("l_linenumber").alias("layer"), F.col("l_returnflag").alias("dataset")).agg(F.avg("l_quantity").alias("score")).join(item(s, d).where("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.avg("l_quantity").alias("baseline")), "dataset"), -5.0, 9.0)
)
_NEW = "CASE WHEN abs(o.top1 - w.top1) > 0.005 THEN o.top1 > w.top1 WHEN o.pair <> w.pair THEN o.pair > w.pair ELSE o.damage < w.damage END"
_BAND = f"""WITH RECURSIVE {_GRID_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY reg, beta, threshold) AS i FROM (SELECT reg, beta, threshold, round(top1, 9) AS top1, round(pair_macro_strict, 9) AS pair, round(damage_rate, 9) AS damage FROM gg)),
w AS (SELECT * FROM o WHERE i = 1 UNION ALL SELECT {", ".join(f"CASE WHEN {_NEW} THEN o.{c} ELSE w.{c} END" for c in ("reg", "beta", "threshold", "top1", "pair", "damage"))}, o.i FROM w JOIN o ON o.i = w.i + 1)
SELECT reg, beta, threshold, {r("top1", "pair", "damage")} FROM w ORDER BY i DESC LIMIT 1"""


@query("sel21_tie_band", _BAND)
def tie_band(s, d):
    """The configurations in their order, each against the best so far: 100 rows."""
    names = ["reg", "beta", "threshold", "top1", "pair", "damage"]
    columns = ["reg", "beta", "threshold", *[F.round(c, 9).alias(n) for c, n in (("top1", "top1"), ("pair_macro_strict", "pair"), ("damage_rate", "damage"))]]
    rows = _grid(s, d).select(*columns).orderBy("reg", "beta", "threshold").collect()
    return s.createDataFrame([tuple(learn.tie_band_choice([x.asDict() for x in rows])[n] for n in names)], ", ".join(f"{n} double" for n in names))


_REC = lambda s, d: metrics.question_outcomes(select.majority_scores(LI(s, d)).withColumn("score", F.round("score", 9))).select("question_uid", (F.col("new_right") - F.col("raw_right")).alias("top1_delta"), "strict", (F.col("raw_right") * (1 - F.col("new_right"))).alias("damage"), F.col("raw_right").alias("raw_correct"))
_REC_SQL = f"{_MAJ}, rec AS (SELECT question_uid, question_uid % 3 AS dataset, new_right - raw_right AS top1_delta, strict, raw_right * (1 - new_right) AS damage, raw_right AS raw_correct FROM oc)"


def _replicates(prefix: str, samples: int, by: str = "", rows: str = "rec") -> str:
    """Records with w, how often each counts in each sample; prefix: SQL of what stands before the question in the hash."""
    times = " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in resample.poisson_steps())
    return f"""hx AS (SELECT *, sha256({prefix} || '|' || question_uid || '|' || block) AS h FROM {rows}, (SELECT unnest(range(0, {-(-samples // 16)})) AS block)),
hv AS (SELECT *, CAST('0x' || substr(h, CAST(16 * c + 1 AS BIGINT), 15) AS BIGINT) AS v FROM hx, (SELECT unnest(range(0, 4)) AS c)),
hu AS (SELECT *, block * 16 + c * 4 + d AS sample, (v >> (15 * d)) & 32767 AS u FROM hv, (SELECT unnest(range(0, 4)) AS d)),
hw AS (SELECT * FROM (SELECT *, {times} AS w FROM hu) WHERE w > 0 AND sample < {samples})"""


def _mean(x: str) -> str:
    return f"sum({x} * w)::DOUBLE / nullif(sum(CASE WHEN {x} IS NOT NULL THEN w END), 0) AS {x}"


def _interval(x: str, table: str) -> str:
    n, low, high = f"count({x})", f"count(*) FILTER ({x} <= 0)", f"count(*) FILTER ({x} >= 0)"
    return f"SELECT '{x}' AS metric, round(quantile_cont({x}, 0.025), 6) + 0.0 AS lower, round(quantile_cont({x}, 0.975), 6) + 0.0 AS upper, round(avg(CASE WHEN {x} > 0 THEN 1 ELSE 0 END), 6) AS p_positive, round(least(1.0::DOUBLE, 2 * least(({low} + 1) / ({n} + 1), ({high} + 1) / ({n} + 1))), 6) AS p_two_sided FROM {table}"


query("bst01_bst03_bst04_bst05_bootstrap_interval", f"WITH {_REC_SQL}, {_replicates(chr(39) + '11' + chr(39), 200)}, rp AS (SELECT sample, {_mean('top1_delta')} FROM hw GROUP BY 1) {_interval('top1_delta', 'rp')}")(
    lambda s, d: resample.interval(resample.bootstrap(_REC(s, d), ["top1_delta", "strict"], {"damage_rate": ("damage", "raw_correct")}, 200, 11), "top1_delta")
)
query("bst01_bst03_replicates", f"WITH {_REC_SQL}, {_replicates(chr(39) + '11' + chr(39), 40)} SELECT sample, round(avg(top1_delta), 6) + 0.0 AS top1_delta, round(avg(strict), 6) + 0.0 AS strict, round(max(damage_rate), 6) + 0.0 AS damage_rate FROM (SELECT sample, {_mean('top1_delta')}, {_mean('strict')}, sum(damage * w)::DOUBLE / greatest(sum(raw_correct * w), 1) AS damage_rate FROM hw GROUP BY 1) GROUP BY 1")(
    lambda s, d: resample.bootstrap(_REC(s, d), ["top1_delta", "strict"], {"damage_rate": ("damage", "raw_correct")}, 40, 11)
)
query("bst02_macro_bootstrap", f"WITH {_REC_SQL}, {_replicates(chr(39) + '13|' + chr(39) + ' || dataset', 100)}, re AS (SELECT dataset, sample, {_mean('top1_delta')} FROM hw GROUP BY 1, 2), rp AS (SELECT sample, avg(top1_delta) AS top1_delta FROM re GROUP BY 1) {_interval('top1_delta', 'rp')}")(
    lambda s, d: resample.interval(resample.macro_bootstrap(_REC(s, d).withColumn("dataset", F.col("question_uid") % 3), "dataset", ["top1_delta"], {}, 100, 13), "top1_delta")
)
query("bst06_pair_bootstrap", f"WITH {_REC_SQL}, eligible AS (SELECT * FROM rec WHERE strict IS NOT NULL), {_replicates(chr(39) + '17' + chr(39), 100, rows='eligible')}, rp AS (SELECT sample, {_mean('strict')} FROM hw GROUP BY 1) {_interval('strict', 'rp')}")(
    lambda s, d: resample.interval(resample.bootstrap(_REC(s, d).where("strict IS NOT NULL"), ["strict"], {}, 100, 17), "strict")
)
query("smp04_lrn01_lrn02_ranker_fit")(lambda s, d: s.createDataFrame([(select.FEATURES[i], float(w)) for i, w in enumerate(learn.fit_ranker(learn.pair_differences(LI(s, d), 3), 0.01))], "feature string, weight double"))
query("sel33_learned_ranking_pass")(lambda s, d: (m := learn.ranker_models(LI(s, d), (1, 2, 3), 0.01)) and select.fused_scores(LI(s, d).drop("label").withColumn("label", F.lit(None).cast("int")), m, 0.5, 0.1).select("question_uid", "candidate_index", "score"))
query("bud05_exact_subsets", f"WITH {SQL_LI}, q AS (SELECT question_uid FROM v GROUP BY 1 HAVING count(*) BETWEEN 4 AND 16), k AS (SELECT v.*, row_number() OVER (PARTITION BY question_uid {BEST}) - 1 AS r, count(*) OVER (PARTITION BY question_uid) AS n FROM v JOIN q USING (question_uid)) SELECT question_uid, round(sum(CASE WHEN label = 1 THEN list_product(list_concat([1.0], list_transform(range(0, 3), lambda i: greatest(n - r - 1 - i, 0) / (n - 1 - i)))) * 4 / n ELSE 0 END), 6) + 0.0 AS raw FROM k GROUP BY 1")(
    lambda s, d: resample.exact_subsets(LI(s, d).withColumn("n", F.count("*").over(sequences.question())).where("n <= 16"), 4).select("question_uid", "raw")  # the SQL's questions: 4 to 16 candidates
)
_TRIPLES = f"""{SQL_LI}, {VK}, s AS (SELECT a.question_uid, [a.candidate_index, b.candidate_index, c.candidate_index] AS s FROM v a JOIN v b ON a.question_uid = b.question_uid AND a.candidate_index < b.candidate_index JOIN v c ON a.question_uid = c.question_uid AND b.candidate_index < c.candidate_index),
m AS (SELECT vk.*, s FROM (SELECT question_uid, s, unnest(s) AS candidate_index FROM s) JOIN vk USING (question_uid, candidate_index)),
t AS (SELECT *, max(rm / 4) OVER (PARTITION BY question_uid, s, cluster) AS t FROM m),
g AS (SELECT question_uid, s, cluster, count(*) AS n, max(rm) AS top, min(candidate_index) AS first, round(4 * (max(t) + ln(sum(exp(rm / 4 - t)))), 9) AS mass, arg_max(label, (rm, -candidate_index)) AS label FROM t GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY question_uid, s ORDER BY top DESC, first) AS a, row_number() OVER (PARTITION BY question_uid, s ORDER BY n DESC, top DESC, first) AS b, row_number() OVER (PARTITION BY question_uid, s ORDER BY mass DESC, top DESC, first) AS c FROM g)"""
_OF = lambda x, n: f"round(avg(CASE WHEN {x} = 1 THEN label END), 6) + 0.0 AS {n}"
query("bud05_exact_subsets_rules", f"WITH {_TRIPLES} SELECT question_uid, {_OF('a', 'raw')}, {_OF('b', 'majority')}, {_OF('c', 'weighted')} FROM p GROUP BY 1")(lambda s, d: resample.exact_subsets(LI(s, d), 3))
