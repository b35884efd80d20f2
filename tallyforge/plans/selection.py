"""Queries of clusters, selection, ranking metrics and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, clusters, metrics, select
from ..sources import views
from ..sources.views import SQL_DOC, SQL_EV, SQL_LI
from .base import query, r

KEY = "CASE WHEN answer IS NULL THEN 'u:' || CAST(candidate_index AS VARCHAR) ELSE 'a:' || answer END"
BEST = "ORDER BY rm DESC NULLS LAST, candidate_index"
CL = f"""cl AS (SELECT question_uid, {KEY} AS cluster, max(answer) AS answer, count(*) AS n,
  count(DISTINCT sha256(lower(trim(regexp_replace(solution, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))))) AS unique_solutions,
  max(rm) AS rm_max, min(candidate_index) AS first_index, avg(label) AS label_share FROM v GROUP BY 1, 2)"""
RAW = f"raw AS (SELECT * FROM (SELECT *, {KEY} AS cluster, row_number() OVER (PARTITION BY question_uid {BEST}) AS r FROM v) WHERE r = 1)"
VK = f"vk AS (SELECT *, {KEY} AS cluster FROM v)"


def rep(pick: str) -> str:
    """The best candidate of each chosen cluster; pick: a table of question_uid and cluster."""
    return f"""SELECT question_uid, candidate_index, answer, rm, label FROM (
  SELECT vk.*, row_number() OVER (PARTITION BY vk.question_uid {BEST}) AS r FROM vk JOIN {pick} p ON vk.question_uid = p.question_uid AND vk.cluster = p.cluster) WHERE r = 1"""


def top(table: str, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_uid ORDER BY {order}) AS r FROM {table}) WHERE r = 1)"


def z(table: str, x: str, out: str, keys: str = "question_uid") -> str:
    """A SELECT of table with the ordinary z of x."""
    return f"SELECT *, CASE WHEN stddev_pop({x}) OVER (PARTITION BY {keys}) < 1e-6 THEN 0.0 ELSE ({x} - avg({x}) OVER (PARTITION BY {keys})) / stddev_pop({x}) OVER (PARTITION BY {keys}) END AS {out} FROM {table}"


RZ = """rz0 AS (SELECT *, median(rm) OVER (PARTITION BY question_uid) AS med, stddev_pop(rm) OVER (PARTITION BY question_uid) AS sd FROM v),
rz1 AS (SELECT *, 1.4826 * median(abs(rm - med)) OVER (PARTITION BY question_uid) AS mad FROM rz0),
rz AS (SELECT *, (rm - med) / CASE WHEN mad >= 1e-6 THEN mad WHEN sd >= 1e-6 THEN sd ELSE 1.0 END AS z FROM rz1)"""

for name, view, text in (("li", views.lineitem_candidates, SQL_LI), ("ev", views.event_candidates, SQL_EV)):

    def q(key: str, sql: str, name=name):
        return query(f"{key}_{name}", sql)

    q("win01_sel01_raw_choice", f"WITH {text} SELECT question_uid, candidate_index, answer, rm, label FROM (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS r FROM v) WHERE r = 1")(
        lambda s, d, view=view: clusters.raw_choice(view(s, d)).select("question_uid", "candidate_index", "answer", "rm", "label")
    )
    q("agg05_clusters", f"WITH {text}, {CL} SELECT question_uid, cluster, answer, n, unique_solutions, rm_max, first_index, {r('label_share')} FROM cl")(lambda s, d, view=view: clusters.clusters(view(s, d)))
    q("win03_robust_z", f"WITH {text}, {RZ} SELECT question_uid, candidate_index, {r('z')} FROM rz")(lambda s, d, view=view: clusters.with_robust_z(view(s, d)).select("question_uid", "candidate_index", "z"))
    q("win04_ordinary_z", f"WITH {text} SELECT question_uid, candidate_index, {r('z')} FROM ({z('v', 'rm', 'z')})")(lambda s, d, view=view: clusters.with_z(view(s, d)).select("question_uid", "candidate_index", "z"))
    q(
        "agg07_agg12_cluster_features",
        f"""WITH {text}, {RZ},
f0 AS (SELECT *, {KEY} AS cluster, count(*) OVER (PARTITION BY question_uid) AS total, row_number() OVER (PARTITION BY question_uid {BEST}) AS place FROM rz),
f1 AS (SELECT *, max(z) OVER (PARTITION BY question_uid, cluster) AS t FROM f0),
f AS (SELECT question_uid, cluster, min(candidate_index) AS first_index, ln(1 + count(*)) AS log_size, count(*) / max(total) AS share,
  ln(1 + count(DISTINCT sha256(lower(trim(regexp_replace(solution, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))))) AS log_unique, max(z) AS z_max, avg(z) AS z_mean,
  max(t) + ln(avg(exp(z - t))) AS z_lme, stddev_pop(z) AS z_std, max(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS has_raw FROM f1 GROUP BY 1, 2)
SELECT question_uid, cluster, first_index, {r("log_size", "share", "log_unique", "z_max", "z_mean", "z_lme", "z_std")}, has_raw FROM f""",
    )(lambda s, d, view=view: clusters.cluster_features(view(s, d)))
    q("agg11_flt04_trainable", f"WITH {text}, {CL} SELECT question_uid FROM cl GROUP BY 1 HAVING bool_or(label_share >= 0.5) AND bool_or(label_share < 0.5)")(lambda s, d, view=view: clusters.trainable(view(s, d)))
    q("sel02_sel04_majority_unique", f"WITH {text}, {CL}, {VK} " + rep(top("cl", "unique_solutions DESC, rm_max DESC, first_index")))(lambda s, d, view=view: select.majority_unique(view(s, d)))
    q("sel03_majority_count", f"WITH {text}, {CL}, {VK} " + rep(top("cl", "n DESC, rm_max DESC, first_index")))(lambda s, d, view=view: select.majority_count(view(s, d)))
    q(
        "sel07_majority_none_on_tie",
        f"""WITH {text}, {VK},
c AS (SELECT question_uid, cluster, count(*) AS n, max(label) AS any_right, arg_max(label, (rm, -candidate_index)) AS best_label FROM vk GROUP BY 1, 2),
t AS (SELECT question_uid, count(*) > 1 AS tie, max(any_right) AS any_right, max(best_label) AS best_label FROM (SELECT *, rank() OVER (PARTITION BY question_uid ORDER BY n DESC) AS r FROM c) WHERE r = 1 GROUP BY 1)
SELECT question_uid, tie, CASE WHEN tie THEN 0 ELSE best_label END AS correct, CASE WHEN tie THEN any_right ELSE best_label END AS optimistic_correct FROM t""",
    )(lambda s, d, view=view: select.majority_none_on_tie(view(s, d)))
    q("sel08_majority_earliest", f"WITH {text}, {CL} SELECT question_uid, answer, n, first_index FROM {top('(SELECT * FROM cl WHERE answer IS NOT NULL)', 'n DESC, first_index')}")(lambda s, d, view=view: select.majority_earliest(view(s, d)))
    q("agg03_composition", f"WITH {text}, g AS (SELECT question_uid, min(label) AS lo, max(label) AS hi FROM v GROUP BY 1) SELECT count(*) FILTER (hi = 0) AS all_wrong, count(*) FILTER (lo = 0 AND hi = 1) AS mixed, count(*) FILTER (lo = 1) AS all_correct FROM g")(
        lambda s, d, view=view: metrics.composition(view(s, d))
    )
    PAIRS = "pr AS (SELECT a.question_uid, count(*) FILTER (a.rm > b.rm) AS wins, count(*) FILTER (a.rm = b.rm) AS ties, count(*) AS pairs FROM v a JOIN v b ON a.question_uid = b.question_uid AND a.label = 1 AND b.label = 0 GROUP BY 1)"
    q("jn09_agg17_pair_counts", f"WITH {text}, {PAIRS} SELECT g.question_uid, CAST(coalesce(wins, 0) AS BIGINT) AS wins, CAST(coalesce(ties, 0) AS BIGINT) AS ties, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs FROM (SELECT DISTINCT question_uid FROM v) g LEFT JOIN pr ON g.question_uid = pr.question_uid")(
        lambda s, d, view=view: metrics.pair_counts(view(s, d), "rm")
    )
    q(
        "agg17_pair_micro_macro",
        f"WITH {text}, {PAIRS} SELECT CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(pairs - wins - ties) AS BIGINT) AS losses, CAST(sum(ties) AS BIGINT) AS ties, round(sum(wins) / sum(pairs), 6) AS micro, round(avg(wins / pairs), 6) AS macro_strict, round(avg((wins + 0.5 * ties) / pairs), 6) AS macro_half_tie FROM pr",
    )(
        lambda s, d, view=view: metrics.pair_counts(view(s, d), "rm").where("pairs > 0").agg(
            F.sum("wins").alias("wins"), F.sum(F.col("pairs") - F.col("wins") - F.col("ties")).alias("losses"), F.sum("ties").alias("ties"), (F.sum("wins") / F.sum("pairs")).alias("micro"),
            F.avg(F.col("wins") / F.col("pairs")).alias("macro_strict"), F.avg((F.col("wins") + 0.5 * F.col("ties")) / F.col("pairs")).alias("macro_half_tie"),
        )
    )
    q("agg18_auc_pooled", f"WITH {text}, a AS (SELECT rm, label, rank() OVER (ORDER BY rm) AS k FROM v), b AS (SELECT label, k + (count(*) OVER (PARTITION BY rm) - 1) / 2.0 AS k FROM a) SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * 1.0 * count(*) FILTER (label = 0)), 6) AS auc FROM b")(
        lambda s, d, view=view: metrics.auc(view(s, d))
    )
    q(
        "agg19_agg20_tie_diagnostics",
        f"""WITH {text}, a AS (SELECT *, rank() OVER (PARTITION BY question_uid ORDER BY rm DESC) AS r, row_number() OVER (PARTITION BY question_uid {BEST}) AS k FROM v),
g AS (SELECT question_uid, count(*) FILTER (r = 1) AS tied, max(CASE WHEN k = 1 THEN label END) AS f, max(CASE WHEN r = 1 THEN label END) AS a, avg(CASE WHEN r = 1 THEN label END) AS e, count(DISTINCT rm) AS kinds FROM a GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN tied > 1 THEN 1 ELSE 0 END), 6) AS tie_rate, round(avg(f), 6) AS top1, round(avg(a), 6) AS optimistic_top1, round(avg(e), 6) AS tie_aware_top1, round(avg(CASE WHEN kinds = 1 THEN 1 ELSE 0 END), 6) AS all_equal_rate FROM g""",
    )(lambda s, d, view=view: metrics.tie_diagnostics(view(s, d)))
    KS = "ks AS (SELECT unnest([1, 4, 8]) AS k)"
    PASS = "q AS (SELECT question_uid, count(*) AS n, sum(label) AS c FROM v GROUP BY 1), ps AS (SELECT question_uid, k, 1 - list_product(list_transform(range(0, k), lambda i: greatest(n - c - i, 0) / (n - i))) AS pass_at_k FROM q, ks WHERE n >= k)"
    BESTK = f"""rk AS (SELECT question_uid, label, row_number() OVER (PARTITION BY question_uid {BEST}) - 1 AS r, count(*) OVER (PARTITION BY question_uid) AS n FROM v),
bs AS (SELECT question_uid, k, sum(CASE WHEN label = 1 THEN list_product(list_concat([1.0], list_transform(range(0, k - 1), lambda i: greatest(n - r - 1 - i, 0) / (n - 1 - i)))) * k / n ELSE 0 END) AS best_at_k FROM rk, ks WHERE n >= k GROUP BY 1, 2)"""
    q("bud01_bud02_bud03_pass_at_k", f"WITH {text}, {KS}, {PASS} SELECT question_uid, k, {r('pass_at_k')} FROM ps")(lambda s, d, view=view: budget.pass_at_k(view(s, d), [1, 4, 8]))
    q("bud04_win09_best_at_k", f"WITH {text}, {KS}, {BESTK} SELECT question_uid, k, {r('best_at_k')} FROM bs")(lambda s, d, view=view: budget.best_at_k(view(s, d), [1, 4, 8]))
    q(
        "bud06_budget_table",
        f"WITH {text}, {KS}, {PASS}, {BESTK} SELECT k, count(*) AS eligible_questions, max(t.n) AS total_questions, round(count(*) / max(t.n), 6) AS coverage, round(avg(pass_at_k), 6) AS pass_at_k, round(avg(best_at_k), 6) AS selection_at_k, round(avg(pass_at_k) - avg(best_at_k), 6) + 0.0 AS oracle_gap FROM ps JOIN bs USING (question_uid, k), (SELECT count(DISTINCT question_uid) AS n FROM v) t GROUP BY k",
    )(lambda s, d, view=view: budget.budget_table(view(s, d), [1, 4, 8]))
    q("win13_prefix_pass", f"WITH {text}, {KS}, h AS (SELECT question_uid, k, max(CASE WHEN candidate_index < k THEN label ELSE 0 END) AS hit FROM v, ks GROUP BY 1, 2) SELECT k, count(*) AS questions, round(avg(hit), 6) AS prefix_pass FROM h GROUP BY k")(
        lambda s, d, view=view: budget.prefix_pass(view(s, d), [1, 4, 8])
    )

EV, LI = views.event_candidates, views.lineitem_candidates
query("agg06_str06_unique_support_doc", f"WITH {SQL_DOC}, {CL} SELECT question_uid, cluster, n, unique_solutions FROM cl")(lambda s, d: clusters.clusters(views.document_candidates(s, d)).select("question_uid", "cluster", "n", "unique_solutions"))


def mass(tau: float, name: str = "ms") -> str:
    return f"""{name} AS (SELECT question_uid, cluster, max(t) + ln(sum(exp(rm / {tau} - t))) AS mass, max(rm) AS rm_max, min(candidate_index) AS first_index
  FROM (SELECT *, max(rm / {tau}) OVER (PARTITION BY question_uid, cluster) AS t FROM vk) GROUP BY 1, 2)"""


def weighted_pick(tau: float, thr: float) -> str:
    return f"""(SELECT b.question_uid, CASE WHEN b.cluster <> m.cluster AND b.mass - m.mass <= {thr} THEN m.cluster ELSE b.cluster END AS cluster
  FROM {top("ms", "mass DESC, first_index")} b JOIN raw USING (question_uid) JOIN ms m ON m.question_uid = raw.question_uid AND m.cluster = raw.cluster)"""


query("agg13_log_sum_exp", f"WITH {SQL_EV}, {VK}, {mass(4.0)} SELECT question_uid, cluster, {r('mass')}, rm_max, first_index FROM ms")(lambda s, d: select.masses(EV(s, d), 4.0))
for _tau, _thr in ((4.0, 0.0), (8.0, 0.5), (16.0, 2.0)):
    query(f"sel09_weighted_vote_tau{_tau:g}_thr{str(_thr).replace('.', 'p')}", f"WITH {SQL_EV}, {VK}, {RAW}, {mass(_tau)} " + rep(weighted_pick(_tau, _thr)))(lambda s, d, t=_tau, h=_thr: select.weighted_vote(EV(s, d), t, h))
query("sel10_weighted_tau4", f"WITH {SQL_EV}, {VK}, {mass(4.0)} " + rep(top("ms", "mass DESC, rm_max DESC, first_index")))(lambda s, d: select.weighted_vote_tied(EV(s, d)))
CONF = "exp(-abs(rm) / 100)"


def _conf():
    return F.exp(-F.abs("rm") / 100)



def conf_pick(t: float) -> str:
    return top(f"(SELECT question_uid, cluster, sum(exp((c - m) / {t})) AS mass, max(rm) AS rm_max, min(candidate_index) AS first_index FROM (SELECT *, {CONF} AS c, max({CONF}) OVER (PARTITION BY question_uid) AS m FROM vk) GROUP BY 1, 2)", "round(mass, 9) DESC, rm_max DESC, first_index")


query("sel12_confidence_vote", f"WITH {SQL_EV}, {VK} " + rep(conf_pick(0.5)))(lambda s, d: select.confidence_vote(EV(s, d), _conf(), 0.5))
query("sel13_max_confidence", f"WITH {SQL_EV} SELECT question_uid, candidate_index, label FROM {top(f'(SELECT *, {CONF} AS c FROM v)', 'c DESC, candidate_index')}")(lambda s, d: select.max_confidence(EV(s, d), _conf()))


def expanded(scores: str, thr: float) -> str:
    """CTEs ex: candidates with their expanded score; scores: SELECT question_uid, cluster, first_index, cluster_score."""
    return f"""cs AS ({scores}),
cs1 AS (SELECT cs.*, raw.cluster AS rawc, max(cluster_score) OVER (PARTITION BY cs.question_uid) AS t, max(CASE WHEN cs.cluster = raw.cluster THEN cluster_score END) OVER (PARTITION BY cs.question_uid) AS rs,
  row_number() OVER (PARTITION BY cs.question_uid ORDER BY cluster_score DESC, cs.first_index) AS place FROM cs JOIN raw ON cs.question_uid = raw.question_uid),
cs2 AS (SELECT *, max(CASE WHEN place = 1 AND cluster = rawc THEN 1 ELSE 0 END) OVER (PARTITION BY question_uid) AS same FROM cs1),
cs3 AS (SELECT question_uid, cluster, CASE WHEN same = 0 AND t - rs <= {thr} AND cluster = rawc THEN t + 1e-4 ELSE cluster_score END AS gs FROM cs2),
ex AS (SELECT x.question_uid, x.candidate_index, x.label, x.rm, gs + 1e-4 * rel AS score FROM ({z("vk", "rm", "rel")}) x JOIN cs3 ON x.question_uid = cs3.question_uid AND x.cluster = cs3.cluster)"""


ZU = f"({z('(SELECT *, ln(1 + unique_solutions) AS u FROM cl)', 'u', 'zu')})"
MAJ = f"SELECT question_uid, cluster, first_index, zu + 1e-4 * zr AS cluster_score FROM ({z(ZU, 'rm_max', 'zr')})"
WEI = "SELECT question_uid, cluster, first_index, mass AS cluster_score FROM ms"
MODELS = [[0.4, 0.9, 0.3, 0.6, 0.2, 0.5, -0.1, 0.7], [0.5, 0.7, 0.2, 0.8, 0.1, 0.4, -0.2, 0.6], [0.3, 0.8, 0.4, 0.7, 0.3, 0.3, 0.0, 0.8]]
_W = [sum(m[i] for m in MODELS) / 3 for i in range(8)]
FEAT = f"""{RZ},
f0 AS (SELECT *, {KEY} AS cluster, count(*) OVER (PARTITION BY question_uid) AS total, row_number() OVER (PARTITION BY question_uid {BEST}) AS place FROM rz),
f1 AS (SELECT *, max(z) OVER (PARTITION BY question_uid, cluster) AS t FROM f0),
ft AS (SELECT question_uid, cluster, min(candidate_index) AS first_index, max(rm) AS rm_max, ln(1 + count(*)) AS log_size, count(*) / max(total) AS share, ln(1 + count(DISTINCT sha256(lower(trim(solution))))) AS log_unique, max(z) AS z_max, avg(z) AS z_mean,
  max(t) + ln(avg(exp(z - t))) AS z_lme, stddev_pop(z) AS z_std, max(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS has_raw FROM f1 GROUP BY 1, 2),
ln1 AS (SELECT *, {" + ".join(f"({w!r}) * {c}" for w, c in zip(_W, select.FEATURES, strict=True))} AS learned FROM ft)"""
ZR = f"({z('ln1', 'rm_max', 'zr')})"


def fused(beta: float) -> str:
    return f"SELECT question_uid, cluster, first_index, zr + {beta} * zl AS cluster_score FROM ({z(ZR, 'learned', 'zl')})"


query("sel05_majority_scores", f"WITH {SQL_EV}, {CL}, {VK}, {RAW}, {expanded(MAJ, 0.0)} SELECT question_uid, candidate_index, {r('score')} FROM ex")(lambda s, d: select.majority_scores(EV(s, d)).select("question_uid", "candidate_index", "score"))
query(
    "sel06_majority_scores_counted",
    f"WITH {SQL_EV}, {CL}, {VK}, c AS (SELECT question_uid, cluster, n + 1e-4 * zr AS base FROM ({z('cl', 'rm_max', 'zr')})) SELECT x.question_uid, candidate_index, round(base + 1e-6 * rel, 8) AS score FROM ({z('vk', 'rm', 'rel')}) x JOIN c ON x.question_uid = c.question_uid AND x.cluster = c.cluster",
    places=8,
)(lambda s, d: select.majority_scores_counted(EV(s, d)).select("question_uid", "candidate_index", "score"))
query("sel11_weighted_scores", f"WITH {SQL_EV}, {VK}, {RAW}, {mass(4.0)}, {expanded(WEI, 0.0)} SELECT question_uid, candidate_index, {r('score')} FROM ex")(lambda s, d: select.weighted_scores(EV(s, d)).select("question_uid", "candidate_index", "score"))
query("sel14_learned_cluster_scores", f"WITH {SQL_EV}, {FEAT} SELECT question_uid, cluster, {r('learned')} FROM ln1")(lambda s, d: select.linear_scores(clusters.cluster_features(EV(s, d)), MODELS).select("question_uid", "cluster", "learned"))
query("sel15_sel16_fused_gated_scores", f"WITH {SQL_EV}, {VK}, {RAW}, {FEAT}, {expanded(fused(0.5), 0.2)} SELECT question_uid, candidate_index, {r('score')} FROM ex")(lambda s, d: select.fused_scores(EV(s, d), MODELS, 0.5, 0.2).select("question_uid", "candidate_index", "score"))

OUTCOME = f"""o0 AS (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS a, row_number() OVER (PARTITION BY question_uid ORDER BY score DESC NULLS LAST, candidate_index) AS b FROM ex),
o1 AS (SELECT question_uid, max(CASE WHEN a = 1 THEN label END) AS raw_right, max(CASE WHEN b = 1 THEN label END) AS new_right, max(CASE WHEN a = 1 AND b <> 1 THEN 1 ELSE 0 END) AS switched, count(*) AS n, CAST(sum(label) AS BIGINT) AS c FROM o0 GROUP BY 1),
o2 AS (SELECT x.question_uid, avg(CASE WHEN x.score > y.score THEN 1.0 ELSE 0.0 END) AS strict, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS half_tie FROM ex x JOIN ex y ON x.question_uid = y.question_uid AND x.label = 1 AND y.label = 0 GROUP BY 1),
oc AS (SELECT o1.*, strict, half_tie FROM o1 LEFT JOIN o2 USING (question_uid))"""
REPORT = """count(*) AS questions, round(avg(new_right), 6) AS top1, round(avg(strict), 6) AS pair_macro_strict, round(avg(half_tie), 6) AS pair_macro_half_tie, count(strict) AS eligible,
  round(sum(raw_right * (1 - new_right)) / greatest(sum(raw_right), 1), 6) AS damage_rate, round(sum((1 - raw_right) * new_right) / greatest(sum(1 - raw_right), 1), 6) AS correction_rate, round(avg(switched), 6) AS switch_rate,
  CAST(sum((1 - raw_right) * new_right) - sum(raw_right * (1 - new_right)) AS BIGINT) AS net_corrected"""
ROUND = "ex_r AS (SELECT * REPLACE (round(score, 9) AS score) FROM ex)"


def reported(cte: str) -> str:
    """OUTCOME over scores rounded to nine places, so that both engines see the same ties."""
    return f"{cte}, ex_r AS (SELECT * REPLACE (round(score, 9) AS score) FROM ex), {OUTCOME.replace('FROM ex)', 'FROM ex_r)').replace('FROM ex x JOIN ex y', 'FROM ex_r x JOIN ex_r y')}"


RAWEX = "ex AS (SELECT question_uid, candidate_index, label, rm, rm AS score FROM v)"
METHODS = {
    "raw": (f"{SQL_LI}, {reported(RAWEX)}", lambda c: c.withColumn("score", F.col("rm"))),
    "majority": (f"{SQL_LI}, {CL}, {VK}, {RAW}, {reported(expanded(MAJ, 0.0))}", select.majority_scores),
    "weighted_tau4": (f"{SQL_LI.replace('l_extendedprice AS rm', 'l_extendedprice / 1000 AS rm')}, {VK}, {RAW}, {mass(4.0)}, {reported(expanded(WEI, 0.0))}", None),
    "hybrid_gated": (f"{SQL_LI}, {VK}, {RAW}, {FEAT}, {reported(expanded(fused(0.5), 0.2))}", lambda c: select.fused_scores(c, MODELS, 0.5, 0.2)),
}


def nine(df):
    return df.withColumn("score", F.round("score", 9))


def method_report(s, d):
    """One row for each method: raw, majority, weighted vote and gated hybrid, on the same candidates."""
    out = None
    for m, (_, f) in METHODS.items():
        cand = LI(s, d)
        scored = f(cand) if f else select.weighted_scores(cand.withColumn("rm", F.col("rm") / 1000))
        one = metrics.ranking_metrics(metrics.question_outcomes(nine(scored))).select(F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


query("agg14_agg15_method_report", "\nUNION ALL\n".join(f"SELECT * FROM (WITH {cte} SELECT '{m}' AS method, {REPORT} FROM oc)" for m, (cte, _) in METHODS.items()))(method_report)
_MAJ = METHODS["majority"][0]
query("bud07_question_records", f"WITH {_MAJ} SELECT question_uid, raw_right, new_right, switched, n, c, {r('strict', 'half_tie')} FROM oc")(lambda s, d: metrics.question_outcomes(nine(select.majority_scores(LI(s, d)))))
_LI_EX = METHODS["hybrid_gated"][0]
query("bud08_point_metrics", f"WITH {_MAJ} SELECT question_uid % 3 AS dataset, {REPORT} FROM oc GROUP BY 1")(lambda s, d: metrics.ranking_metrics(metrics.question_outcomes(nine(select.majority_scores(LI(s, d)))).withColumn("dataset", F.col("question_uid") % 3), "dataset"))
query("agg16_macro_pooled", f"WITH {_MAJ}, p AS (SELECT question_uid % 3 AS dataset, avg(new_right) AS top1, avg(strict) AS pair, avg(switched) AS switch_rate FROM oc GROUP BY GROUPING SETS ((question_uid % 3), ())) SELECT CASE WHEN dataset IS NULL THEN 'pooled' ELSE 'macro' END AS kind, round(avg(top1), 6) AS top1, round(avg(pair), 6) AS pair, round(avg(switch_rate), 6) AS switch_rate FROM p GROUP BY 1")(
    lambda s, d: metrics.question_outcomes(nine(select.majority_scores(LI(s, d)))).withColumn("dataset", F.col("question_uid") % 3).groupingSets([[F.col("dataset")], []], F.col("dataset"))
    .agg(F.avg("new_right").alias("top1"), F.avg("strict").alias("pair"), F.avg("switched").alias("switch_rate"))
    .groupBy(F.when(F.col("dataset").isNull(), "pooled").otherwise("macro").alias("kind")).agg(F.avg("top1").alias("top1"), F.avg("pair").alias("pair"), F.avg("switch_rate").alias("switch_rate"))
)
query(
    "agg44_oracle_summary",
    f"""WITH {SQL_LI}, {CL}, g AS (SELECT question_uid, count(*) AS n, sum(label) AS c FROM v GROUP BY 1), m AS (SELECT question_uid, count(*) AS clusters, max(n) AS support FROM cl GROUP BY 1)
SELECT count(*) AS questions, count(*) FILTER (c > 0) AS solvable, count(*) FILTER (c = n) AS all_correct, round(avg(c / n), 6) AS mean_label, round(avg(clusters), 6) AS mean_clusters, round(avg(support / n), 6) AS mean_top_support, max(support) AS max_support FROM g JOIN m USING (question_uid)""",
)(
    lambda s, d: (c := LI(s, d)).groupBy("question_uid").agg(F.count("*").alias("n"), F.sum("label").alias("c"))
    .join(clusters.clusters(c).groupBy("question_uid").agg(F.count("*").alias("clusters"), F.max("n").alias("support")), "question_uid")
    .agg(F.count("*").alias("questions"), F.count_if(F.expr("c > 0")).alias("solvable"), F.count_if(F.expr("c = n")).alias("all_correct"), F.avg(F.col("c") / F.col("n")).alias("mean_label"), F.avg("clusters").alias("mean_clusters"), F.avg(F.col("support") / F.col("n")).alias("mean_top_support"), F.max("support").alias("max_support"))
)

_UNG, _GAT = expanded(fused(0.5), -1e9), expanded(fused(0.5), 0.2)


def _two(s, d):
    c = EV(s, d)
    a = nine(select.fused_scores(c, MODELS, 0.5, -1e9)).withColumnRenamed("score", "ungated")
    return a.join(nine(select.fused_scores(c, MODELS, 0.5, 0.2)).select("question_uid", "candidate_index", F.col("score").alias("gated")), ["question_uid", "candidate_index"])


def _cte(x: str, tag: str) -> str:
    import re

    return re.sub(r"\b(cs[123]?|ex)\b", lambda m: m[1] + tag, x)


_GA = f"""{SQL_EV}, {VK}, {RAW}, {FEAT}, {_cte(_UNG, "_u")}, {_cte(_GAT, "_g")},
w AS (SELECT u.question_uid, u.candidate_index, u.label, u.rm, round(u.score, 9) AS ungated, round(g.score, 9) AS gated FROM ex_u u JOIN ex_g g ON u.question_uid = g.question_uid AND u.candidate_index = g.candidate_index),
k AS (SELECT *, row_number() OVER (PARTITION BY question_uid {BEST}) AS a, row_number() OVER (PARTITION BY question_uid ORDER BY ungated DESC, candidate_index) AS b, row_number() OVER (PARTITION BY question_uid ORDER BY gated DESC, candidate_index) AS c FROM w),
g AS (SELECT question_uid, max(CASE WHEN a = 1 THEN candidate_index END) AS ri, max(CASE WHEN a = 1 THEN label END) AS rok, max(CASE WHEN b = 1 THEN candidate_index END) AS ui, max(CASE WHEN b = 1 THEN label END) AS uok, max(CASE WHEN c = 1 THEN candidate_index END) AS gi, max(CASE WHEN c = 1 THEN label END) AS gok FROM k GROUP BY 1),
h AS (SELECT *, ri <> ui AS p, ri <> ui AND gi = ui AS acc, ri <> ui AND gi = ri AS rej, rok = 0 AND uok = 1 AS up, rok = 1 AND uok = 0 AS down FROM g)"""
query(
    "agg36_gate_audit",
    f"""WITH {_GA} SELECT count(*) AS questions, count(*) FILTER (p) AS proposal_switches, count(*) FILTER (acc) AS accepted_switches, count(*) FILTER (acc AND up) AS accepted_corrections, count(*) FILTER (acc AND down) AS accepted_damages, count(*) FILTER (acc AND NOT up AND NOT down) AS accepted_neutral,
  count(*) FILTER (rej) AS rejected_switches, count(*) FILTER (rej AND down) AS prevented_damages, count(*) FILTER (rej AND up) AS blocked_corrections, count(*) FILTER (rej AND NOT up AND NOT down) AS rejected_neutral, CAST(sum(CASE WHEN p THEN gok - uok ELSE 0 END) AS BIGINT) AS net_saved, round(avg(CASE WHEN p THEN 1 ELSE 0 END), 6) AS proposal_switch_rate FROM h""",
)(lambda s, d: metrics.gate_audit(_two(s, d)))
query("agg37_transition_table", f"WITH {_MAJ} SELECT question_uid % 3 AS dataset, count(*) FILTER (raw_right = 1 AND new_right = 1) AS stay_right, count(*) FILTER (raw_right = 0 AND new_right = 0) AS stay_wrong, count(*) FILTER (raw_right = 1 AND new_right = 0) AS damaged, count(*) FILTER (raw_right = 0 AND new_right = 1) AS corrected FROM oc GROUP BY 1")(
    lambda s, d: metrics.transition(metrics.question_outcomes(nine(select.majority_scores(LI(s, d)))).withColumn("dataset", F.col("question_uid") % 3), F.col("raw_right"), F.col("new_right"), "dataset")
)

SEED_SQL = "rm * 0.9 + 0.01 * (candidate_index % 7) AS s1, rm * 1.1 - 0.02 * (candidate_index % 5) AS s2, rm + 0.03 * (candidate_index % 3) AS s3"


def _seeds(c):
    i = F.col("candidate_index")
    return c.withColumns({"s1": F.col("rm") * 0.9 + 0.01 * (i % 7), "s2": F.col("rm") * 1.1 - 0.02 * (i % 5), "s3": F.col("rm") + 0.03 * (i % 3)})


query(
    "sel28_jn19_trust_region",
    f"""WITH {SQL_EV}, a AS (SELECT *, {SEED_SQL}, row_number() OVER (PARTITION BY question_uid {BEST}) AS r FROM v),
b AS (SELECT *, max(CASE WHEN r = 1 THEN rm END) OVER w AS raw_rm, max(CASE WHEN r = 1 THEN candidate_index END) OVER w AS raw_index, s1 - max(CASE WHEN r = 1 THEN s1 END) OVER w AS g1, s2 - max(CASE WHEN r = 1 THEN s2 END) OVER w AS g2, s3 - max(CASE WHEN r = 1 THEN s3 END) OVER w AS g3 FROM a WINDOW w AS (PARTITION BY question_uid)),
c AS (SELECT *, (g1 + g2 + g3) / 3 AS m FROM b),
e AS (SELECT *, round(5.0 * (m - 0.5 * sqrt(((g1 - m) * (g1 - m) + (g2 - m) * (g2 - m) + (g3 - m) * (g3 - m)) / 3)) - (raw_rm - rm), 9) AS evidence FROM (SELECT * EXCLUDE (r) FROM c WHERE r > 1))
SELECT question_uid, raw_index, candidate_index AS challenger, round(evidence, 6) + 0.0 AS evidence, CASE WHEN evidence > 0 THEN candidate_index ELSE raw_index END AS choice FROM {top("e", "evidence DESC, candidate_index")}""",
)(lambda s, d: select.trust_region(_seeds(EV(s, d)), ["s1", "s2", "s3"], 5.0, 0.5))
query(
    "sel22_residual_blend",
    f"WITH {SQL_EV} SELECT question_uid, candidate_index, round(rm + 0.3 * ((s1 + s2 + s3) / 3 - rm), 6) + 0.0 AS mean_blend, round(rm + 0.3 * (list_median([s1, s2, s3]) - rm), 6) + 0.0 AS median_blend, round(rm + 2.0 * (exp(2 * ((s1 - rm) / 5)) - 1) / (exp(2 * ((s1 - rm) / 5)) + 1), 6) + 0.0 AS bounded FROM (SELECT *, {SEED_SQL} FROM v)".replace("list_median", "list_aggregate").replace("([s1, s2, s3])", "([s1, s2, s3], 'median')"),
)(
    lambda s, d: _seeds(EV(s, d)).select(
        "question_uid", "candidate_index", select.residual_blend(F.col("rm"), [F.col(x) for x in ("s1", "s2", "s3")], 0.3).alias("mean_blend"),
        select.residual_blend(F.col("rm"), [F.col(x) for x in ("s1", "s2", "s3")], 0.3, True).alias("median_blend"), select.bounded_residual(F.col("rm"), (F.col("s1") - F.col("rm")) / 5, 2.0).alias("bounded"),
    )
)
