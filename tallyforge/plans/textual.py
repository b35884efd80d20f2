"""Queries of text functions, parsers and chunking, over documents and over text made from columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..sources.views import table
from .base import query
from .corpora import COLLAPSE, SQUEEZE

docs = lambda s, d: table(s, d, "documents")
query("str05_normalize_text", f"SELECT doc_id, {COLLAPSE.format('text')} AS t FROM documents")(lambda s, d: docs(s, d).select("doc_id", T.collapse(F.col("text")).alias("t")))
query("str01_squeeze", f"SELECT doc_id, {SQUEEZE.format('text')} AS t FROM documents")(lambda s, d: docs(s, d).select("doc_id", T.squeeze(F.col("text")).alias("t")))
query("str01_squeeze_nfkc")(lambda s, d: docs(s, d).select("doc_id", T.squeeze_nfkc(F.col("text")).alias("t")))
query("str02_latex_key")(lambda s, d: docs(s, d).select("doc_id", T.latex_key(F.col("text")).alias("t")))
query("str03_compact_key")(lambda s, d: docs(s, d).select("doc_id", T.compact_key(F.col("text")).alias("t")))
query("str04_token_key", r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]'), ' ') AS t FROM documents")(lambda s, d: docs(s, d).select("doc_id", T.token_key(F.col("text"), True).alias("t")))
query("str07_short_id", "SELECT doc_id, substr(sha256(source || '|' || lang || '|' || doc_id), 1, 16) AS uid FROM documents")(lambda s, d: docs(s, d).select("doc_id", T.short_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("uid")))
_CH = "'  Option: \\text{(' || l_returnflag || ') ' || l_linestatus || '}. '"
query("str08_choice_key", r"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(l_returnflag || ') ' || l_linestatus || ' ' || strftime(l_shipdate, '%Y-%m-%d')) AS k FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select(*KEY, T.choice_key(F.concat(F.lit(" \t Option: \\text{\\mathbf{("), "l_returnflag", F.lit(")} "), "l_linestatus", F.lit("\u00a0 "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" }. "))).alias("k"))
)
query("str12_length_ratio", "SELECT a.item_id, round(least(length(a.text), length(b.text)) / greatest(length(a.text), length(b.text)), 6) AS ratio FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")(
    lambda s, d: (b := table(s, d, "benchmark")) and b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("u")), "item_id").select("item_id", T.length_ratio(F.col("text"), F.col("u")).alias("ratio"))
)
query("str13_render_prompt", "SELECT item_id, 'Solve: ' || text || ' Box the answer.' AS prompt FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", T.render("Solve: {problem} Box the answer.", "{problem}", F.col("text")).alias("prompt")))
_SENT = "regexp_replace(text, '([.!?])\\s+([A-Z0-9#`$\\\\])', '\\1' || chr(1) || '\\2', 'g')"
query("txt02_sentences", f"SELECT doc_id, CAST(len(list_filter(string_split({_SENT}, chr(1)), lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS n FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))
)
query("txt02_txt04_chunk_ends")(lambda s, d: docs(s, d).select("doc_id", T.chunk_end_places(F.col("text")).alias("ends")))
query("txt01_lines", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: trim(x) <> '')) AS INTEGER) AS n FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.size(F.filter(F.split("text", "[\\r\\n]+"), lambda x: F.trim(x) != "")).alias("n")))
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEY)
_N = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"


def _n():
    return F.col("l_quantity").cast("bigint").cast("string")


_li = lambda s, d: table(s, d, "lineitem")
query("prs03_hash_marker", f"SELECT {_K}, {_N} AS answer FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.hash_answer(F.concat(F.lit("step one #### 7\nso total is "), _n(), F.lit(" #### "), _n())).alias("answer")))
query("prs03_answer_phrase", f"SELECT {_K}, {_N} || ' units' AS answer FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.phrase_answer(F.concat(F.lit("We add.\nThe answer is "), _n(), F.lit(" units"))).alias("answer")))
query("prs03_last_number", f"SELECT {_K}, {_N} AS answer FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.last_number(F.concat(F.lit("9 of them\nthat makes 3 and "), _n(), F.lit(" in all"))).alias("answer")))


def _branches(n):
    """A solution for each way to find an answer, by line: ####, a box with a fraction, a phrase, the last number, a box with text macros, none, a decimal in a box."""
    line = F.col("l_linenumber")
    says = [
        F.concat(F.lit("so \\boxed{1}\n#### "), n, F.lit(",000 ")), F.concat(F.lit("\\fbox{\\dfrac{"), n, F.lit("}{12}} \\boxed{3}")), F.concat(F.lit("Add. The final answer is "), n, F.lit(" Units.")),
        F.concat(F.lit("7 of them\nthat makes 3 and "), n, F.lit("/7 in all")), F.concat(F.lit("\\boxed{2} x{1} \\boxed{\\left(\\text{ "), n, F.lit(" }\\right)}"))
    ]
    rest = F.when(line == 6, F.lit("no digits here")).otherwise(F.concat(F.lit("first \\boxed{9} then \\boxed{= $\u2212"), n, F.lit(".5$.}")))
    return reduce(lambda out, i: F.when(line == i + 1, says[i]).otherwise(out), range(len(says)), rest)


def _ratio(a: str, b: str) -> str:
    return f"'number:' || CAST(({a}) // gcd({a}, {b}) AS BIGINT) || '/' || CAST(({b}) // gcd({a}, {b}) AS BIGINT)"


query(
    "prs01_prs02_prs03_answers",
    f"""WITH x AS (SELECT {_K}, CAST(l_quantity AS BIGINT) AS n FROM lineitem)
SELECT {_K}, CASE l_linenumber WHEN 1 THEN 'number:' || n * 1000 || '/1' WHEN 2 THEN {_ratio("n", "12")} WHEN 3 THEN 'expr:' || n || 'units' WHEN 4 THEN {_ratio("n", "7")} WHEN 5 THEN 'number:' || n || '/1' WHEN 7 THEN 'number:-' || (2 * n + 1) || '/2' END AS answer,
  ['hash', 'boxed', 'final_phrase', 'last_number', 'boxed', 'unparsed', 'boxed'][l_linenumber] AS method FROM x""",
)(lambda s, d: _li(s, d).select(*KEY, P.answer_udf()(_branches(_n())).alias("x")).select(*KEY, "x.answer", "x.method"))
query("prs05_prs06_generation_answer", f"SELECT {_K}, {_N} AS answer, 'boxed' AS method FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.generation_udf()(F.concat(F.lit("\\boxed{} \\boxed {"), _n(), F.lit("} \\boxed{0}"))).alias("x")).select(*KEY, "x.answer", "x.method"))
query("prs07_prs08_final_answer", f"SELECT {_K}, {_N} AS answer, 'boxed' AS method FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.final_udf()(F.concat(F.lit("\\boxed{1} **Final Answer** \\boxed{"), _n(), F.lit("} \\boxed{2}"))).alias("x")).select(*KEY, "x.answer", "x.method"))
query("prs04_box_contents", f"SELECT {_K}, '1|' || {_N} AS boxes FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, F.array_join(P.box_contents(F.concat(F.lit("\\boxed{1} \\boxed{ } \\boxed{"), _n(), F.lit("}"))), "|").alias("boxes")))
query("str14_truncate_through_answer", f"SELECT {_K}, 'a #### ' || {_N} AS answer, 'hash' AS method FROM lineitem")(lambda s, d: _li(s, d).select(*KEY, P.truncate_udf()(F.concat(F.lit("a #### "), _n(), F.lit("\nmore text"))).alias("x")).select(*KEY, "x.answer", "x.method"))


#: What a row says, by its line: label, place, text, label and text, a label and another's text, a choice behind a cue after another, none.
def _said(flag, place, own, other):
    line = F.col("l_linenumber")
    box = lambda *x: F.concat(F.lit("so \\boxed{"), *x, F.lit("}"))
    return (
        F.when(line == 1, box(F.lit("("), flag, F.lit(")."))).when(line == 2, box(place)).when(line == 3, box(F.lit("Answer: \\text{"), F.upper(own), F.lit("}")))
        .when(line == 4, box(flag, F.lit(") "), own)).when(line == 5, box(flag, F.lit(". "), other)).when(line == 6, F.concat(box(other), F.lit(" **Final answer** "), box(F.lit("zz")), box(flag)))
        .otherwise(F.concat(F.lit("choice "), flag))
    )


@query(
    "prs09_prs10_final_choice",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber IN (5, 7) THEN NULL ELSE 'choice:' || (list_position(['A', 'N', 'R'], l_returnflag) - 1) END AS choice,
  ['boxed_choice_label', 'boxed_choice_positional_alias', 'boxed_choice_text', 'boxed_choice_label_and_text', 'unparsed', 'boxed_choice_label', 'unparsed'][l_linenumber] AS method FROM lineitem""",
)
def final_choice(s, d):
    labels, texts = F.array(*map(F.lit, "ANR")), F.array(*map(F.lit, ["red", "green", "blue"]))
    i = F.array_position(labels, F.col("l_returnflag")).cast("int")
    said = _said(F.col("l_returnflag"), i.cast("string"), F.get(texts, i - 1), F.get(texts, i % 3))
    rows = _li(s, d).select(*KEY, said.alias("said"), labels.alias("labels"), texts.alias("texts"))
    return P.final_choices(rows, "said", "labels", "texts").select(*KEY, "choice", "method")


query("prs11_choice_index", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber < 3 THEN l_linenumber ELSE CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER) END AS i FROM lineitem")(
    lambda s, d: _li(s, d).select(*KEY, P.choice_index(F.col("l_linenumber").cast("string"), F.lower("l_returnflag"), F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("i"))
)
query("prs12_frozen_answer", "SELECT doc_id, 'expr:' || lower(lang || source) AS a, 'number:' || doc_id || '/2' AS b, CASE WHEN doc_id % 2 = 0 THEN 'expr:X ' || lang ELSE 'expr:x' || lower(lang) END AS c FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", P.frozen_answer(F.concat(F.upper("lang"), F.lit(" \t"), "source")).alias("a"), P.frozen_answer(F.concat(F.lit("number:"), F.col("doc_id").cast("string"), F.lit("/2"))).alias("b"), P.frozen_answer(F.concat(F.when(F.col("doc_id") % 2 == 0, "expr:X ").otherwise("X "), "lang")).alias("c"))
)
query("jsn02_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("j")).select("event_id", "j.k"))
query("dat01_utc_stamp", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")))
