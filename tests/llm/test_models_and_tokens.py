"""Language ID, packing, training order, token counts: held-out accuracy, brute force and round trips."""

import json
import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .helpers import ODD, clashing, prose, table
from tallyforge.llm import language_id, packing, token_counts, tokens, training_order

BYTE, WORDS = packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("word_bpe_49k.json")
STRINGS = ["don't we'll they'RE 'tis ''s x's!'s 123 4٣½ ²", "İstanbul ΣΑΣ ς ñandú é a<|endoftext|>b <|startoftext|>", "", "a" * 50 + "!" * 9 + "???", "日本語テキスト 中文 кириллица हिन्दी 🙂🙂👩‍👧", "​ x y\x1cz\x85w", "x" * 3000, "abc'd'm've'l'll'r're", " \n\n  \t a  b"]
ANY = st.text(alphabet=st.sampled_from(list("abcdestlmrv'' !?.09<|é🙂ßΣİ\n\t%")), max_size=60)

# language ID


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    parts = {"aa": ["ba", "na", "ko", "lu", "mi"], "bb": ["str", "cht", "ein", "und", "sch"], "cc": ["que", "eau", "ion", "ée", "ou"]}[lang]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speech(lang, i, 3 + i % 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 120)]
    return table(spark, rows)


def test_held_out_accuracy_and_rejection(spark, spoken):
    model = language_id.fit(spoken, ~language_id.held_out())
    got = language_id.predict(clashing(spoken), model)
    pred, _, rejected = got.columns[-3:]
    assert got.where(language_id.held_out() & (F.col(pred) != F.col("lang"))).count() == 0 and got.where(language_id.held_out()).count() > 50
    assert got.where(F.col(rejected)).count() == 0
    strange = table(spark, [(1, "zzqx wxyz qqjj vvkk xxyy " * 40, None), (2, "!!! 123", None), (3, None, None), (4, speech("bb", "new"), None)])
    out = {x.doc_id: x for x in language_id.predict(strange, model).collect()}
    assert out[1].rejected and out[1].lang_pred in ("aa", "bb", "cc")
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[2].rejected and out[3].score == 0
    assert out[4].lang_pred == "bb" and not out[4].rejected and out[4].score > 0.99


def kneser_ney(texts, order):
    """P(code | codes before) of one language, from dicts of counts: plain, recursive, by the formula."""
    padded = []
    for t in texts:
        out, last = [" "] * (order - 1), False
        for c in t.lower():
            letter = unicodedata.category(c)[0] in "LM"
            if letter or last:
                out.append(c if letter else " ")
            last = letter
        padded.append(out)
    counts = {order: Counter(tuple(p[i - order + 1 : i + 1]) for p in padded for i in range(order - 1, len(p)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {}
    for n, c in counts.items():
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        cut[n] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(code, before, n, alphabet):
        if n == 0:
            return 1 / alphabet
        before = tuple(before[len(before) - n + 1 :])
        kinds = {g: v for g, v in counts[n].items() if g[:-1] == before}
        lower = p(code, before[1:], n - 1, alphabet)
        total = sum(kinds.values())
        return lower if not total else max(kinds.get((*before, code), 0) - cut[n], 0) / total + cut[n] * len(kinds) / total * lower

    return p, {g[0] for g in counts[1]}


def test_language_model_against_dicts_and_its_sums():
    samples = {"aa": [speech("aa", i, 12) for i in range(20)], "bb": [speech("bb", i, 9) + " Été, 9!" for i in range(20)]}
    model = language_id.Model(samples, order=3)
    plain = [kneser_ney([t for i, t in enumerate(samples[k]) if i % 5], 3) for k in ("aa", "bb")]
    known = plain[0][1] | plain[1][1]
    table_ = np.unpackbits(model.letters).astype(bool)
    codes, at, _ = language_id.prepared([speech("aa", 77, 5) + " zß", speech("bb", 78, 5)], table_, 3)
    for place in at[::3]:
        log_p = model.log_p(codes, np.array([place]))[0]
        before = [chr(c) for c in codes[place - 2 : place]]
        want = [p(chr(codes[place]), before, 3, len(known) + 1) for p, _ in plain]
        assert np.allclose(np.exp(log_p.astype(float)), want, rtol=2e-6, atol=0)
        total = np.zeros(2)
        for c in [*map(ord, known), 0x4E00]:  # all codes that are known, and one that stands for all others
            x = codes.copy()
            x[place] = c
            total += np.exp(model.log_p(x, np.array([place]))[0].astype(float))
        assert np.allclose(total, 1, atol=2e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_rejection_of_languages_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = ~language_id.held_out()
    whole = language_id.fit(docs, train)
    got = language_id.predict(docs, whole).where(language_id.held_out() & (F.col("lang_pred") != "und"))
    assert got.where(F.col("rejected")).count() <= 0.01 * got.count()
    assert (whole.false_rejection <= 0.01).all() and (whole.foreign_rejection >= 0.75).all()  # texts in two languages are among them
    for lang in whole.languages:
        model = language_id.fit(docs.where(F.col("lang") != lang), train)
        strange = language_id.predict(docs.where((F.col("lang") == lang) & (F.length("text") > 100)), model)
        n, gone = strange.agg(F.count("*"), F.count_if("rejected")).first()
        assert n > 20 and gone >= 0.85 * n, (lang, gone, n)  # some are half in another language, or labelled wrongly


def test_one_long_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "Model", lambda samples, order, keep: samples)
    order = F.xxhash64(F.lit(12), F.xxhash64(F.lit(11), F.col("id").cast("string")))
    first = [x.id for x in spark.range(30).orderBy(order).collect()][1]
    docs = table(spark, [(i, "long " * 1000 if i == first else f"text {i:02}", "aa") for i in range(30)])
    got = language_id.fit(docs, F.lit(True), train_chars=2000)["aa"]
    assert sorted(t for t in got if not t.startswith("long")) == [f"text {i:02}" for i in range(30) if i != first] and sum(map(len, got)) <= 2000


def test_language_odd_rows_and_no_labels(spark):
    docs = table(spark, [(i, t, None) for i, t, _ in ODD])
    model = language_id.fit(docs, F.lit(True))
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(ODD) and {x.lang_pred for x in got} == {"und"}
    labelled = language_id.fit(table(spark, ODD), F.lit(True))
    got = language_id.predict(table(spark, ODD), labelled).collect()
    assert len(got) == len(ODD) and all((x.lang_pred == "und") == (not any(c.isalpha() for c in x.text or "")) for x in got)
    assert language_id.predict(table(spark, []), labelled).count() == 0


# tokens and packing


def test_fast_ids_are_the_library_ids():
    exact, enc = Tokenizer.from_file(BYTE), tokens.encoder(BYTE)
    assert enc.fast is not None
    for t in STRINGS + [prose(1, 500)]:
        assert enc.ids(t) == exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_fast_ids_on_any_text(t):
    assert tokens.encoder(BYTE).ids(t) == Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids if len(t) < 3 else True
    assert tokens.encoder(BYTE).ids(t) == tokens.encoder(BYTE).exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_sum_of_squares_places_as_defined(sizes):
    size, gaps, n = 30, Counter(), 0
    of, at, made = packing.place(np.array(sizes, np.int64), size)
    for i, s in enumerate(sizes):
        options = {}
        for g in [g for g in gaps if gaps[g] and g >= s]:
            after = gaps.copy()
            after[g] -= 1
            if g > s:
                after[g - s] += 1
            options[g] = sum(v * v for v in after.values())
        best = min(options, key=lambda g: (options[g], g)) if options else size
        assert at[i] == size - best
        n += best == size
        gaps[best] -= best < size
        if best > s:
            gaps[best - s] += 1
    assert made == n
    for b in range(made):
        own = sorted((int(at[i]), sizes[i]) for i in range(len(sizes)) if of[i] == b)
        assert own and own[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(own[:-1], own[1:], strict=True)) and sum(own[-1]) <= size


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_packing_is_near_the_bound(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BYTE).agg(F.count_distinct("sequence_id").alias("n"), F.sum("length").alias("s")).first()
    assert got.n <= got.s / 1024 * 1.005 + 1


def test_packing_in_groups_keeps_ids_and_full_pieces(spark):
    """Ids repeat, are null or too large for a double, and groups are small."""
    rows = [(2**62 + 1 + i % 2, prose(i, 30 + i % 90), "en") for i in range(60)] + [(None, prose(i, 50), "en") for i in range(60)] + [(7, prose(1, 4000), "en")]
    got = packing.pack(table(spark, rows), BYTE, 128, group=25).collect()
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in v) <= 128 and all(a + n == b for (a, n), (b, _) in zip(sorted(v)[:-1], sorted(v)[1:], strict=True)) and min(v)[0] == 0 for v in by.values())
    assert Counter(x.doc_id for x in got if x.piece == 0) == Counter(i for i, _, _ in rows)
    assert all((x.sequence_id < 0) == (x.length == 128) for x in got) and len({x.sequence_id >> 40 for x in got if x.sequence_id >= 0}) >= 4


def test_packing_is_whole_and_tight(spark):
    rows = ODD + [(100 + i, prose(i, i * 7 % 900), "en") for i in range(80)]
    docs = clashing(table(spark, rows))
    got = packing.pack(docs, BYTE, 256).toPandas()
    exact = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        k = -(-len(ids) // 256)
        for p in range(k):
            a = 0 if p == 0 else len(ids) - 256 * (k - p)
            part = ids[a : len(ids) - 256 * (k - p - 1)]
            want[i, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    have = Counter((None if x.doc_id != x.doc_id else int(x.doc_id) if abs(x.doc_id) < 2**53 else 2**62, x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    assert have == want
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all() and q.groupby("sequence_id").length.sum().max() <= 256
    assert got.sequence_id.nunique() <= got.length.sum() / 256 * 1.05 + 2
    assert packing.pack(table(spark, []), BYTE).count() == 0


# training order


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**32))
def test_feistel_is_a_permutation(n, key):
    assert sorted(training_order.feistel(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_round_trip(spark, tmp_path):
    rows = ODD + [(100 + i, prose(i, i * 5), "en") for i in range(60)] + [(-(2**63), "the least id", "en"), (0, "zero", "en")]
    docs = clashing(table(spark, rows)).repartition(5)  # no plain scan: it is written out first
    how = training_order.write_shards(docs, str(tmp_path / "shards"), BYTE, size=128, width=50)
    got = training_order.read_shards(spark, str(tmp_path / "shards")).collect()
    assert json.loads((tmp_path / "shards" / training_order.MANIFEST).read_text()) == how == training_order.manifest(spark, str(tmp_path / "shards"))
    assert sorted(x.slot for x in got) == list(range(how["n"]))
    exact = Tokenizer.from_file(BYTE)
    want, have = Counter(), Counter()
    for i, t, _ in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 128):
            want[i, a, tuple(ids[a : a + 128])] += 1
    for x in got:
        have[x.doc_id, x.start, tuple(x.ids)] += 1
        assert x.n_tokens == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        assert x.offset == (x.slot - how["first"][x.shard]) * how["stride"]
    assert have == want
    files = sorted((tmp_path / "shards").glob("part-*"))
    assert sum(f.stat().st_size for f in files) == how["stride"] * how["n"] and len(files) == len(how["first"])
    order = [np.frombuffer(f.read_bytes(), np.uint8).reshape(-1, how["stride"])[:, :8].copy().view("<i8").ravel() for f in files]
    assert all((np.diff(np.concatenate(order)) > 0).tolist()) and all(len({int(v) // 50 for v in o}) <= 1 for o in order)
    one = got[7]
    with open(files[one.shard], "rb") as f:  # any slot by one seek
        f.seek(one.offset)
        head = np.frombuffer(f.read(training_order.HEAD.itemsize), training_order.HEAD)[0]
        assert head["start"] == one.start and np.frombuffer(f.read(256), "<u2")[: one.n_tokens].tolist() == one.ids
    again = training_order.write_shards(docs, str(tmp_path / "again"), BYTE, size=128, width=50)
    assert again == how


def test_splits_without_rows(spark, tmp_path):
    rows = [(i, prose(i, 400), "en") for i in range(30)]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        docs = spark.read.parquet(str(tmp_path / "in"))
        assert docs.rdd.getNumPartitions() > 5
        training_order.write_shards(docs, str(tmp_path / "out"), BYTE)
        assert {x.doc_id for x in training_order.read_shards(spark, str(tmp_path / "out")).collect()} == set(range(30))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_shards_of_nothing(spark, tmp_path):
    how = training_order.write_shards(table(spark, []), str(tmp_path / "none"), BYTE)
    assert how["n"] == 0 and training_order.read_shards(spark, str(tmp_path / "none")).count() == 0


# token counts


def test_reading_goes_on_from_any_slot(spark, tmp_path):
    """What is read up to a slot and from it on is all, once each; shards without such slots aren't opened."""
    docs, out = table(spark, [(i, prose(i, 150), "en") for i in range(40)]), str(tmp_path / "shards")
    how = training_order.write_shards(docs, out, BYTE, size=32, width=60)
    slots = lambda *at: sorted(x.slot for x in training_order.read_shards(spark, out, *at).collect())
    every = {x.slot: (x.doc_id, x.start, x.ids) for x in training_order.read_shards(spark, out).collect()}
    assert sorted(every) == list(range(how["n"])) and len(how["shards"]) > 5
    for stop in (1, how["first"][2], how["first"][3] + 5, how["n"] - 1):
        assert slots(0, stop) + slots(stop) == list(range(how["n"]))
    begin, end = how["first"][2] + 3, how["first"][4] + 2
    for name in sorted(tmp_path.joinpath("shards").glob("part-*")):
        if training_order.shard_of(str(name)) in (how["shards"][0], how["shards"][5]):
            name.write_bytes(b"not a shard")
    got = {x.slot: (x.doc_id, x.start, x.ids) for x in training_order.read_shards(spark, out, begin, end).collect()}
    assert got == {k: v for k, v in every.items() if begin <= k < end}
    assert slots(how["n"]) == [] and slots(5, 5) == [] and slots(how["n"] - 2, 10**9) == [how["n"] - 2, how["n"] - 1]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(WORDS)


def library(t):
    return len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids)


def test_totals_and_prefixes_are_the_library_ones(counter):
    exact = Tokenizer.from_file(WORDS)
    texts = STRINGS + [prose(i, 80) for i in range(20)]
    assert counter.totals([*texts, None]).tolist() == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts] + [0]
    for t in texts:
        if "<|" not in t and len(t) < 1000:
            low = counter.normalised(t)
            assert counter.prefixes(t).tolist() == [len(exact.encode(low[: i + 1], add_special_tokens=False).ids) for i in range(len(low))]


def test_any_text_counts_as_in_the_library(counter):
    exact = Tokenizer.from_file(WORDS)

    @settings(max_examples=300, deadline=None)
    @given(ANY)
    def check(t):
        assert counter.totals([t])[0] == len(exact.encode(t, add_special_tokens=False).ids)

    check()


def test_counts_survive_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "ENTRIES", 50)
    monkeypatch.setattr(token_counts, "MEMO", 4)
    c, exact = token_counts.Counter(WORDS), Tokenizer.from_file(WORDS)
    for i in range(6):
        texts = [prose(i * 10 + k, 60) for k in range(5)]
        assert c.totals(texts).tolist() == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_tokens_and_budgets(spark):
    docs = clashing(table(spark, ODD))
    got = token_counts.count_tokens(docs, WORDS, budgets=(0, 5, 10**9))
    n, fits = got.columns[-2:]
    exact = Tokenizer.from_file(WORDS)
    rows = got.collect()
    assert Counter((x.doc_id, x[n]) for x in rows) == Counter((i, len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    for x in rows:
        low = token_counts.Counter.normalised(x.text or "")
        assert x[fits][2] == len(low) and len(exact.encode(low[: x[fits][1]], add_special_tokens=False).ids) <= 5
    assert token_counts.count_tokens(table(spark, []), WORDS).count() == 0
