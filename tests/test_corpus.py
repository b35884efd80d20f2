"""Order by hash, duplicates, weights, contamination and nearest texts against direct versions."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import indel_ratio
from tallyforge.functions import text as T
from tallyforge.operators import corpus


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def test_places_in_hash_order(spark):
    rows = [(["a", "b", None][i % 3], i) for i in range(700)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = corpus.in_hash_order(df, ["g"], "place", corpus.hashed("s", F.col("i")), "i").collect()
    want = defaultdict(list)
    for g, i in rows:
        want[g].append(i)
    place = {(g, i): k for g, own in want.items() for k, i in enumerate(sorted(own, key=lambda x: sha("s", x)), 1)}
    assert len(got) == len(rows) and {(x.g, x.i): x.place for x in got} == place
    assert got[0].asDict().keys() == {"g", "i", "place"}
    assert corpus.in_hash_order(df.where("false"), ["g"], "place", corpus.hashed("s", F.col("i"))).count() == 0


def test_epochs_hold_every_item_once(spark):
    got = [x.i for x in corpus.shuffled_epochs(spark.range(50).select(F.col("id").alias("i")), "i", 125, "e").orderBy("position").collect()]
    assert len(got) == 125 and sorted(got[:50]) == sorted(got[50:100]) == list(range(50)) and len(set(got[100:])) == 25 and got[:50] != got[50:100]


def test_duplicates_with_null_empty_and_hot_keys(spark):
    r = random.Random(1)
    rows = [(i, "" if i % 3 == 0 else None if i % 17 == 0 else r.choice("abcdefgh") * r.randint(1, 40), "xy"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, v string")
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    got = {(x.i, x.duplicate_of) for x in corpus.internal_duplicates(df, F.col("t"), "i").collect()}
    assert got == {(i, first[t]) for i, t, _ in rows if first[t] != i}  # null is a key like others, and not the empty one


def test_records_of_a_signature(spark):
    rows = [(1, "s", "x"), (2, "s", "y"), (3, "s", None), (4, "t", "x"), (5, None, "x"), (6, None, "x")]
    got = corpus.duplicate_records(spark.createDataFrame(rows, "i int, s string, v string"), F.col("s"), "i", F.col("v")).collect()
    assert {(x.signature, x.i, x.n, x.variants) for x in got} == {("s", 1, 3, 2), ("s", 2, 3, 2), ("s", 3, 3, 2), (None, 5, 2, 1), (None, 6, 2, 1)}


def test_pair_weights_have_a_mean_of_one(spark):
    r = random.Random(3)
    c = [(q, r.randint(0, 1)) for q in range(40) for _ in range(r.randint(1, 8))]
    n = Counter(c)
    pairs = {q: n[q, 0] * n[q, 1] for q in range(40) if n[q, 0] * n[q, 1]}
    sizes = Counter(q % 2 for q in pairs)
    raw = {q: 0.5 / sizes[q % 2] / m for q, m in pairs.items()}
    mean = sum(raw[q] * m for q, m in pairs.items()) / sum(pairs.values())
    got = corpus.pair_weights(spark.createDataFrame(c, "question_uid int, label int"), F.col("question_uid") % 2).collect()
    assert {x.question_uid: (x.pairs, x.weight) for x in got} == {q: (m, pytest.approx(raw[q] / mean)) for q, m in pairs.items()}


def test_contamination_by_normal_form_then_by_ratio(spark):
    r = random.Random(4)
    base = ["".join(r.choices("abcdefg hij", k=r.randint(20, 80))).strip() for _ in range(30)]
    other = [(100 + i, t) for i, t in enumerate(base)] + [(200, None), (201, "")]
    own = [(0, base[3].upper() + "  "), (1, base[4] + "z"), (2, "nothing like any of these 12345"), (3, None), (4, " "), (5, base[5][: len(base[5]) // 2])]
    a, b = spark.createDataFrame(own, "i int, t string"), spark.createDataFrame(other, "j int, u string")
    got = {x.i: (x.external_id, x.reason, x.score) for x in corpus.contamination(a, b, "i", "t", "j", "u").collect()}
    normal = lambda t: "".join(t.lower().split())
    best = max((indel_ratio(normal(own[1][1]), normal(t)), -j) for j, t in other if t)
    assert got == {0: (103, "normalized_exact", 100.0), 1: (-best[1], "fuzzy", pytest.approx(best[0]))}


def test_nearest_texts_and_their_risk(spark):
    others = [(1, "Find the sum of 1 and 2."), (2, "find the SUM of 1 and 2"), (3, "A train leaves at 9"), (4, None), (5, "...")]
    own = [(1, "Find the sum of 1 and 2!"), (2, "Find the sum of 1 and 3"), (3, "!!"), (4, "unlike 77")]
    a, b = spark.createDataFrame(own, "q int, t string"), spark.createDataFrame(others, "item int, u string")
    top = corpus.fuzzy_top(a, b, "q", "t", "item", "u", 2)
    rows = {(x.q, x["rank"]): x for x in top.collect()}
    assert rows[1, 1]["item"] == 1 and rows[1, 1].exact and rows[1, 1].occurrences == 2 and len([k for k in rows if k[0] == 1]) == 2
    assert rows[2, 1].score == pytest.approx(indel_ratio("findthesumof1and3", "findthesumof1and2")) and not rows[2, 1].exact
    risk = {x.q: (x.exact_match, x.high_risk, x.review) for x in corpus.match_risk(top, "q").collect()}
    assert risk == {1: (True, True, True), 2: (False, rows[2, 1].token_score >= 95, True), 4: (False, False, False)}


def test_hash_edges_are_those_of_a_sort(spark, monkeypatch):
    """Narrowed down by digits (few rows may be sorted), with ties, null groups, and groups of fewer rows than are taken."""
    import hashlib

    monkeypatch.setattr(corpus, "_EDGE", 5)
    rows = [(None if i % 3 == 2 else "ab"[i % 3], i // 2 if i % 7 == 0 else i) for i in range(3000)] + [("few", 1), ("few", 2), ("same", 9), ("same", 9), ("same", 9), ("none", 1)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(4)
    take = F.when(F.col("g") == "a", 700).when(F.col("g") == "few", 10).when(F.col("g") == "none", 0).when(F.col("g") == "same", 2).otherwise(1)
    want = {}
    for g in {g for g, _ in rows} - {"none"}:
        h = sorted(hashlib.sha256(f"s|{i}".encode()).hexdigest() for x, i in rows if x == g)
        want[g] = h[min({"a": 700, "few": 10, "same": 2}.get(g, 1), len(h)) - 1]
    got = corpus.hash_edges(df, ["g"], take, corpus.hashed("s", F.col("i"))).collect()
    assert {r.g: r.edge for r in got} == want and len(got) == len(want)
    assert corpus.hash_edges(df.where("false"), ["g"], take, F.col("g")).collect() == []
    whole = sorted(hashlib.sha256(f"s|{i}".encode()).hexdigest() for _, i in rows)[99]
    assert corpus.hash_edges(df, [], F.lit(100), corpus.hashed("s", F.col("i"))).first().edge == whole


def test_split_takes_the_first_in_hash_order(spark):
    import hashlib

    ids = [f"u{i}" for i in range(333)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:50]], "u string")
    first = set(sorted(ids, key=lambda i: hashlib.sha256(f"x|{i}".encode()).hexdigest())[: round(333 * 0.1)])
    got = corpus.hash_split(df, "u", 0.1, "x").collect()
    assert {r.u for r in got if r.in_sample} == first and len(got) == 383
    assert not any(r.in_sample for r in corpus.hash_split(df, "u", 0.0, "x").collect())


def test_short_items_in_blocks(spark, monkeypatch):
    """Items without an inner word, in more than one block."""
    monkeypatch.setattr(corpus, "SHORT_ITEMS", 40)
    texts = [(i, f"alpha{i} beta gamma{i % 7} Delta") for i in range(40)] + [(99, None), (98, "")]
    items = [(j, f"a{j}" if j % 2 else f"{j} beta") for j in range(30)] + [(50, "lph"), (51, "TA GAM"), (52, ""), (53, None), (54, "one two three")]
    got = {tuple(r) for r in corpus.contains_matches(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(items, "j int, u string"), "i", "t", "j", "u").collect()}
    assert got == {(i, j) for i, t in texts for j, u in items if t and u and u.lower() in t.lower()}


def test_capped_pairs_are_the_first_in_hash_order(spark):
    import hashlib

    rows = [("a", i, i % 3 == 0) for i in range(40)] + [("b", 0, True), ("c", 0, False), (None, 0, True), (None, 1, False)]
    df = spark.createDataFrame([(q, i, None if i == 39 else int(y)) for q, i, y in rows], "question_uid string, candidate_index int, label int")
    got = sorted((r.p, r.q) for r in corpus.capped_pairs(df, 25, "s").where("question_uid = 'a'").collect())
    right, wrong = [i for i in range(39) if i % 3 == 0], [i for i in range(39) if i % 3]
    want = sorted(((p, q) for p in right for q in wrong), key=lambda x: hashlib.sha256(f"s|a|{x[0]}|{x[1]}".encode()).hexdigest())[:25]
    assert got == sorted(want)
    assert corpus.capped_pairs(df, 25, "s").where("question_uid IN ('b', 'c')").count() == 0 and corpus.capped_pairs(df.where("false"), 3, "s").count() == 0


def test_audited_split_step_by_step(spark):
    """Exact and near copies of the others, later rows of one form, and the rest, by plain Python over normal forms."""
    import hashlib
    import math
    import random

    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "sum", "of", "three", "numbers", "is", "find", "x"]
    base = [" ".join(r.choices(words, k=r.randint(12, 20))) for _ in range(60)]
    others = [(100 + i, t) for i, t in enumerate(base[:12])] + [(200, None), (201, "")]
    texts = base + [t.upper() for t in base[:3]] + [t[:-1] for t in base[3:8]] + [t[: len(t) // 2] for t in base[8:12]] + [base[30], base[30], None, "", "  "]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, s string")
    ratios = {"train": 0.65, "a": 0.1, "b": 0.1, "test": 0.15}
    split, out, found = corpus.audited_split(df, spark.createDataFrame(others, "j int, u string"), "i", "t", "j", "u", F.col("s"), ratios, "x")
    key = {x.i: x.k for x in df.select("i", T.latex_key(F.col("t")).alias("k")).collect()}
    other = {x.j: x.k for x in spark.createDataFrame(others, "j int, u string").select("j", T.latex_key(F.col("u")).alias("k")).collect()}
    why, seen, marks = {}, {}, {}
    for i, _, _ in rows:
        k, own = key[i], []
        if k and k in other.values():
            own.append("external_exact")
        elif k:
            best = max((T.indel_ratio(k, u) for u in other.values() if u), default=0)
            if best >= 92:
                marks[i] = best
            if best >= 96:
                own.append("external_fuzzy")
        if k in seen:
            own.append("internal_duplicate")
        seen.setdefault(k, i)
        if own:
            why[i] = ",".join(sorted(own))
    assert {x.i: x.reasons for x in out.collect()} == why and "external_fuzzy" in why.values()
    assert {x.i for x in found.where("reason = 'fuzzy'").collect()} == set(marks)
    want = {}
    for s in "ab":
        ids = sorted((i for i, _, g in rows if g == s and i not in why), key=lambda i: hashlib.sha256(f"x|{i}".encode()).hexdigest())
        n = {k: math.floor(len(ids) * v) for k, v in ratios.items()}
        order = sorted(ratios, key=lambda k: (-round(len(ids) * ratios[k] - n[k], 9), hashlib.sha256(f"x|{k}|{s}".encode()).hexdigest()))
        for k in order[: len(ids) - sum(n.values())]:
            n[k] += 1
        names = [k for k in ratios for _ in range(n[k])]
        want |= dict(zip(ids, names, strict=True))
    assert {x.i: x.split for x in split.collect()} == want
