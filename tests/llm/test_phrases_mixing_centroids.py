"""Phrase collocations, source mixing and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .helpers import LOWER, ODD, clashing, prose, table
from tallyforge.llm import centroids, mixing, phrases

# phrases


def brute_phrases(rows, max_n=4, least=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * candidates[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def zipf(seed, n, size=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(size)]
    text = r.choices(words, [1 / (i + 1) for i in range(size)], k=n)
    return "".join(w + r.choice([" "] * 12 + ["\t", ", ", ". ", "\n", "  "]) for w in text)


def test_phrases_equal_brute_force(spark):
    rows = [(i, zipf(i, 400), ["en", "de", None][i % 3]) for i in range(60)] + [(100 + i, "The SAME passage of many, many words", "en") for i in range(40)] + ODD
    df = table(spark, rows)
    assert got(phrases.collocations(df)) == brute_phrases(rows)
    assert got(phrases.collocations(clashing(df).repartition(7))) == brute_phrases(rows)
    assert got(phrases.collocations(df, max_n=3, least=5, share=50, top=40)) == brute_phrases(rows, 3, 5, 50, 40)


def test_phrases_nothing(spark):
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [(1, None, None), (2, " , ", "en")])).collect() == []


def test_one_beginning_over_many_partitions(spark):
    """A first word of most suffixes, split by range: partial counts add up."""
    rows = [(i, " . ".join(f"hot {a} {b}" for a, b in zip(zipf(i, 300).split(), zipf(-i - 1, 300).split(), strict=False)), "en") for i in range(20)]
    suffixes = phrases.suffixes(table(spark, rows).select("text", F.lit("en").alias("lang")), *[np.full(phrases._BITS // 8, 255, np.uint8)] * 2, 4)
    order = [F.col(c).desc_nulls_last() for c in ("lang", "w1", "w2", "w3", "w4")]
    found = phrases.prefix_counts(suffixes.repartitionByRange(40, *order).sortWithinPartitions(*order), 4, 1)
    own, brute = Counter(), Counter()
    for r in found.collect():
        own[r.phrase] += r.n
    for _, t, _ in rows:
        for piece in re.split(r"[.,;:!?\n]", t):
            w = piece.split()
            brute.update(" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert own == brute
    assert found.where("NOT whole").count() > 40 and found.where("whole").groupBy("phrase").count().where("count > 1").isEmpty()


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 7)
    text = zipf(1, 500) + " ünï " + zipf(2, 100)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text, None, "", "a b.c"]), "lang": pa.array(["x", "x", "y", "y"])})
    found, want = Counter(), Counter()
    for code, word, of, langs, goes_on, n in phrases._blocks(batch, 3):
        w, on = [word[int(i)].as_py() for i in code], goes_on
        for i in range(n):
            k = 1
            while k < 4 and i + k < len(w) and on[i + k - 1]:
                k += 1
            found[langs[int(of[i])].as_py(), tuple(w[i : i + k])] += 1
    for lang, t in (("x", text), ("y", "a b.c")):
        for piece in re.split(r"[.,;:!?\n]", t):
            w = piece.split()
            want.update((lang, tuple(w[i : i + 4])) for i in range(len(w)))
    assert found == want


def test_frequent_words_by_spark_and_by_task(spark):
    counts = spark.createDataFrame([("en", "ünï", 30), ("de", "b", 99), ("en", "c", 29)], "lang string, w string, n bigint")
    known = phrases.frequent_map(counts.select(F.xxhash64("lang", "w").alias("h"), "n"), 30)
    words, langs = pa.array(["ünï", "b", "c"]), pa.array(["en", "de"])
    assert np.unpackbits(known).sum() == 2
    h = phrases._hashes(np.array([0, 1, 2, 1]), words, np.array([0, 1, 0, 0]), langs)
    assert phrases._known(known, h).tolist() == [True, True, False, False]


def test_pairs_are_counted_in_pieces(spark):
    every = np.full(phrases._BITS // 8, 255, np.uint8)
    docs = spark.createDataFrame([("a b. a b a, b", "x"), ("b a", "x"), ("a b", "y"), (None, "x"), ("a", "x")], "text string, lang string").repartition(3)
    assert sorted(r.n for r in phrases.pair_counts(docs, every).collect()) == [1, 2, 2]


# mixing


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left, open_ = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: Fraction(repeats * sizes[s]) if s in full else left * w[s] / open_ for s in names}
        above = {s for s in names if s not in full and t[s] > repeats * sizes[s]}
        if not above:
            return t
        full |= above


def mix_rows(n, seed=0):
    r = random.Random(seed)
    return [(i, None if i % 50 == 0 else " ".join(["word"] * r.choice([0, 1, 5, 300])), r.choice(["a", "a", "a", "Z", "ä", "", None, f"s{i % 9}"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix_meets_targets(spark):
    rows = mix_rows(1500)
    sizes, n = Counter(), {}
    for i, t, s in rows:
        n[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n[i]
    want, taken = brute_targets(sizes), Counter()
    found = {r.own.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, _, s in rows:
        r = found[i]
        assert (r["size"], r.source_size) == (n[i], sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert r.epochs * n[i] <= r.taken <= min((r.epochs + 1) * n[i], 2 * n[i])
        taken[s] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s]) for s in sizes}
    again = mixing.mix(frame(spark, rows[::-1]).repartition(13)).collect()  # another order and other partitions
    assert {r.own.doc_id: r.taken for r in again} == {i: r.taken for i, r in found.items()}


def test_mix_takes_heavier_documents_first(spark):
    """Of documents of one size, the taken ones are the least of draw / weight; weights change the odds as they should."""
    rows = [(i, "one word more here", "s") for i in range(4000)]
    q = spark.createDataFrame([(i, 3.0 if i % 2 else 1 / 3) for i in range(4000)], "doc_id bigint, weight double")
    found = {r.own.doc_id: r.taken for r in mixing.mix(frame(spark, rows), qualities=q, share=(1, 4), repeats=1).collect()}

    def key(i):
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / (3.0 if i % 2 else 1 / 3)

    best = sorted(range(4000), key=key)[:1000]
    assert {i for i, t in found.items() if t} == set(best)
    assert 0.8 < sum(i % 2 for i in best) / 1000 < 0.95


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")], [(None, "a b c", "x")] * 3, [(7, "a b c d e", "x"), (7, "a b c d e", "x"), (7, "a", "x"), (None, None, None)]])
def test_mix_odd(spark, rows):
    found = mixing.mix(frame(spark, rows).withColumns({"size": F.lit("own"), "key": F.lit(1), "taken": F.lit(2)}), carry=("text", "size", "taken", "doc_id"))
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert found.count() == len(rows) and sum(r.taken for r in found.collect()) == math.floor(Fraction(3, 2) * words)


def test_null_ids_with_qualities(spark):
    rows = [(None, f"a b c {i}", "x") for i in range(50)] + [(i, "d e", "y") for i in range(50)]
    found = mixing.mix(frame(spark, rows), qualities=spark.createDataFrame([(3, 2.0), (4, 0.5)], "id bigint, weight double"))
    assert found.count() == 100 and sum(r.taken for r in found.collect()) == 321 + 128  # 450 by 5 and 2, rounded down


def test_copies_are_the_words_taken(spark):
    rows = [(i, f" x{i}\ty z\n" * (i % 4 + 1), f"s{i % 3}") for i in range(40)]
    mixed = mixing.mix(frame(spark, rows).withColumn("copy", F.lit("own")), carry=("doc_id", "text", "copy"))
    taken, texts, found = {r.own.doc_id: r for r in mixed.collect()}, {i: t for i, t, _ in rows}, defaultdict(list)
    for r in mixing.copies(mixed).collect():
        assert r["copy"] == "own"
        found[r.doc_id].append((r["copy_"], r.text))
    for i, t in texts.items():
        r = taken[i]
        own = [x for _, x in sorted(found[i])]
        assert sum(len(x.split()) for x in own) == r.taken and all(x == t for x in own[: r.epochs]) and all(t.startswith(x) for x in own)


# clustering


def brute_clusters(rows, dims, k, rounds, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    c = [v for *_, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c[j] for j in range(len(c))]
    return sorted((i is None, i or 0, j, d) for (i, v) in kept for d, j in [nearest(v)]) if c else [], c


def vectors(seed, n, dims, spread=1.0, whole=False):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dims)) * 3
    v = centres[r.integers(0, 5, n)] + spread * r.standard_normal((n, dims))
    return [(i, [float(x) for x in (np.round(row) if whole else row.astype(np.float32))]) for i, row in enumerate(v)]


def clustered(spark, rows, kind="float", **how):
    found, c = centroids.cluster(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3), **how)
    return sorted((r.id is None, r.id or 0, r.cluster, r.distance) for r in found.collect()), c


@pytest.mark.parametrize(("dims", "k", "rounds", "whole"), [(4, 8, 6, False), (2, 12, 5, True), (1, 5, 4, True), (16, 30, 3, False), (3, 1, 2, False)])
def test_clusters_equal_brute_force(spark, dims, k, rounds, whole):
    """Whole components make many ties, and centroids that fall on each other."""
    rows = vectors(dims, 300, dims, 1.5, whole)
    scale = 1.0 if whole else 1024.0
    assert clustered(spark, rows, dims=dims, k=k, rounds=rounds, scale=scale) == brute_clusters(rows, dims, k, rounds, scale)


def test_clusters_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [3.0, 4.0]), (8, [0.0, 0.0]), (9, [-1e-30, -0.0]), (10, [1.0, 2.0, 3.0])]
    assert clustered(spark, rows, dims=2) == brute_clusters(rows, 2, 8, 10)
    assert clustered(spark, [(1, None)], dims=2) == ([], [])
    assert clustered(spark, [], dims=2) == ([], [])
    assert clustered(spark, [(None, [1.0, 1.0])], dims=2) == ([], [])


def test_clusters_of_huge_components(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 7) * (i - 20))), float(i), -3e38 if i == 5 else 1e9 * i]) for i in range(40)]
    found, c = clustered(spark, rows, dims=3, k=5, rounds=3)
    want, centres = brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 3, 5, 3)
    assert c == centres and [x[:3] for x in found] == [x[:3] for x in want]
    assert [x[3] for x in found] == [d if d < 2**63 else None for *_, d in want]


def test_search_looks_at_few_centroids():
    """With bounds and balls, later rounds compute a small share of all distances, and the result is that of all."""
    r = np.random.default_rng(3)
    centres = [[int(x) for x in row] for row in r.integers(-4000, 4000, (64, 8))]
    v = np.array(centres, float)[r.integers(0, 64, 5000)] + r.integers(-60, 60, (5000, 8))
    a, u, low = np.full(5000, -1, np.int32), np.full(5000, np.inf), np.zeros(5000)
    now = centroids.Centroids(centres)
    assert now.search(v, a, u, low) == 5000 * 64
    moved = [[x + 3 for x in row] for row in centres]
    then = centroids.Centroids(moved, centres)
    assert then.search(v, a, u, low) < 5000 * 64 * 0.05
    d = ((v[:, None] - np.array(moved, float)) ** 2).sum(2)
    assert (a == d.argmin(1)).all() and (u**2 >= d.min(1)).all()
    far = np.where(np.arange(64) == a[:, None], np.inf, d)
    assert (low**2 <= far.min(1)).all()


def test_drift_of_others():
    c = centroids.Centroids([[0], [3], [9]], [[0], [1], [4]])
    assert np.allclose(c.drift, [0, 2, 5]) and np.allclose(c.others, [5, 5, 2])
    assert np.allclose(centroids.Centroids([[1], [3]], [[0], [2]]).others, [1, 1])
    assert np.allclose(centroids.Centroids([[1]], [[0]]).others, [0])


def test_queries_equal_sql(spark):
    import os

    import __spark_entry__ as driver
    from tests.oracle import difference

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    for name in ("op11_phrase_collocations", "op12_source_mixing", "op13_centroid_clustering"):
        assert difference(spark, driver.queries()[name], driver.oracle_sql()[name], "/root/testdata/sf0.001") == "", name


def test_prose_has_no_shared_state(spark):
    """The same operator twice in one session, on other tables."""
    a, b = [(i, prose(i, 300, 20), "en") for i in range(30)], [(i, prose(i + 50, 300, 20), "fr") for i in range(30)]
    assert got(phrases.collocations(table(spark, a))) == brute_phrases(a)
    assert got(phrases.collocations(table(spark, b))) == brute_phrases(b)
