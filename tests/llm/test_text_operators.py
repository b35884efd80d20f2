"""License scan, line dedup, decontamination: against brute force, on odd rows and on generated text."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import LOWER, ODD, clashing, prose, table, words
from tallyforge.llm import decontaminate, license_scan, line_dedup
from tallyforge.llm.fm_index import FMIndex, Wavelet, suffix_order


def corpus(n=60, seed=0):
    r = random.Random(seed)
    rows = list(ODD)
    for i in range(20, 20 + n):
        parts = [prose(seed * 1000 + i * 10 + k, r.randint(0, 40)) for k in range(r.randint(1, 6))]
        for extra in ("Licensed under the Apache License, Version 2.0.", "A line that stands in many documents, more than twenty long", "  A LINE that stands in many documents, more than twenty LONG\t", "short", "Released under the MIT License", "CC BY CC-BY 4.0", "gnu GENERAL public license"):
            if r.random() < 0.3:
                parts.insert(r.randint(0, len(parts)), extra)
        rows.append((i, "\n".join(parts), r.choice(["en", "fr", None])))
    return rows


# license scan


def licenses(text):
    w, at, labels = words(text), [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    rows = corpus()
    got = license_scan.scan(clashing(table(spark, rows))).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got), key=key) == sorted(((i, *licenses(t)) for i, t, _ in rows), key=key)
    assert all(0 <= x.score <= 1 and (x.score == 1 if x.n_base else True) and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) for x in got)


def test_license_notice_with_words_in_between(spark):
    notice = license_scan.NOTICES[0][0].split()
    cut = notice[:20] + ["xx"] + notice[20:]
    rows = [(1, " ".join(cut), "en"), (2, " ".join(notice[:25]), "en"), (3, "pre " + " ".join(notice).upper() + " post", "en")]
    got = {x.doc_id: x for x in license_scan.scan(table(spark, rows)).collect()}
    assert "mit-notice" in got[1].labels and got[1].score > 0.9 and len(got[1].spans) == 1
    assert "mit-notice" not in got[2].labels and 0 < got[2].score < 0.8
    assert got[3].score == 1 and got[3].spans[0].begin == 1 and got[3].spans[0].end == 1 + len(notice)


def test_license_empty(spark):
    assert license_scan.scan(table(spark, [])).count() == 0


def seconds(run):
    begin = time.time()
    run()
    return time.time() - begin


def test_license_scan_is_linear_in_a_text(spark):
    part = "licensed under the apache license version 2 0 and gnu general public license " + prose(3, 500)
    many, one = table(spark, [(i, part, "en") for i in range(300)]), table(spark, [(1, " ".join([part] * 300), "en")])
    run = lambda d: license_scan.scan(d).collect()
    run(many)
    assert seconds(lambda: run(one)) < 2 * seconds(lambda: run(many)) + 2
    x = run(one)[0]
    assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == licenses(" ".join([part] * 300))


def test_line_dedup_is_linear_in_a_text(spark):
    lines = [f"line {i} that is long enough to count as one" for i in range(40_000)]
    many = [(400 * k + i, "\n".join([*lines[100 * i : 100 * i + 100], f"own {k} {i}"]), "en") for k in range(3) for i in range(400)]
    one = [(k, "\n".join([*lines, f"own {k}"]), "en") for k in range(3)]
    run = lambda rows: line_dedup.dedup_lines(table(spark, rows)).collect()
    run(many)
    assert seconds(lambda: run(one)) < 2 * seconds(lambda: run(many)) + 2
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept) for x in run(one)), key=str) == deduped(one)


def test_license_plan_is_native(spark):
    plan = license_scan.scan(table(spark, ODD))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# line dedup


def deduped(rows, least=20, docs=3):
    found = defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                k = line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
                if len(k) >= least:
                    found[k].add(i)
    keeper = {k: max(v) for k, v in found.items() if len(v) >= docs}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or keeper.get(x.translate(LOWER).strip(" \t\n\x0b\x0c\r"), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(60, seed)
    got = line_dedup.dedup_lines(table(spark, rows))
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept) for x in got.collect()), key=str) == deduped(rows)


def test_line_dedup_clashing_columns_and_empty(spark):
    out = line_dedup.dedup_lines(clashing(table(spark, corpus(10))))
    assert out.columns[-3:] == ["n_lines_", "n_dropped_", "kept_"] and out.where("kept = 'own kept'").count() == len(corpus(10))
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_plan_is_native(spark):
    plan = line_dedup.dedup_lines(table(spark, ODD))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# FM-index and decontamination


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_finds_every_place(runs, phrases):
    text = np.array([x for r in runs for x in (*r, 0)], np.int32)
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    w = Wavelet(text, 5)
    assert w.letter(np.arange(len(text))).tolist() == text.tolist()
    assert all(w.rank(np.full(len(text) + 1, c), np.arange(len(text) + 1)).tolist() == [int((text[:i] == c).sum()) for i in range(len(text) + 1)] for c in range(5))
    index = FMIndex(text, 5)
    for p in phrases:
        lo, hi = index.search(np.array([p]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert found == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]


def hits(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            p = v[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ITEMS = [(1, prose(501, 30)), (2, prose(502, 4)), (3, None), (4, ""), (5, "..."), (None, prose(503, 12)), (10, prose(501, 30) + " " + prose(504, 9)), (11, "one"), (11, prose(505, 15))]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def planted(n=40):
    r = random.Random(3)
    rows = [x for x in ODD if x[0] not in (7, 8)] + [(7, prose(1, 3000) + " " + ITEMS[0][1], "en")]
    for i in range(20, 20 + n):
        w = prose(i, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 3)):
            v = (r.choice(ITEMS)[1] or "").split()
            a = r.randint(0, len(v))
            w[(k := r.randint(0, len(w))) : k] = v[a : a + r.randint(1, 40)]
        rows.append((i, r.choice([", ", " ", "\n", "-"]).join(x.upper() if r.random() < 0.1 else x for x in w), "en"))
    return rows


def test_books_are_small():
    items = [(str(i % 50), prose(i, 3000, 5000)) for i in range(100)]
    book = decontaminate.Book(items, 10)
    assert book.nbytes < 10 * sum(len(t.encode()) for _, t in items)
    assert len(book.start) == len({tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(len(w) - 9)})


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rows = planted()
    got = decontaminate.find_spans(clashing(table(spark, rows)), benchmark(spark))
    n, spans, items = got.columns[-3:]
    out = [(x.doc_id, x[n], sum(s.end_word - s.first_word for s in x[spans]), len(x[items]), hashlib.sha256(",".join(x[items]).encode()).hexdigest()) for x in got.collect()]
    fold = lambda t: (t or "").translate(LOWER)
    want = [(i, *hits(fold(t), [(a, fold(b)) for a, b in ITEMS])) for i, t, _ in rows]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert sum(x[2] > 0 for x in want) > 10


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_spans_are_cut_out(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rows = [*planted(), (900, "one and two", "en")]
    left = decontaminate.remove_spans(clashing(table(spark, rows)), benchmark(spark)).collect()
    assert len(left) == len(rows)
    assert {(i, t) for i, t, _ in rows if not hits(t, ITEMS)[1]} <= {(x.doc_id, x.text) for x in left}
    assert all(hits(x.text, ITEMS)[1] == 0 for x in left)


def test_decontamination_empty_tables(spark):
    assert decontaminate.find_spans(table(spark, []), benchmark(spark)).count() == 0
    got = decontaminate.find_spans(table(spark, ODD), benchmark(spark, [])).collect()
    assert len(got) == len(ODD) and all(not x.spans and not x["items"] for x in got)


def test_words_that_only_share_a_hash_do_not_count(monkeypatch):
    book = decontaminate.Book([("a", "one two three")], 10)
    from tallyforge.llm import words as w

    data = np.frombuffer(b"one two threx", np.uint8)
    at = np.array([0, len(data)])
    real = w.words

    def same_hash(d, a):
        first, end, h = real(d, a)
        return first, end, np.array([real(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[2][0] for x in (b"one", b"two", b"three")])

    monkeypatch.setattr(decontaminate.words, "words", same_hash)
    n, spans, items = decontaminate.shard_hits(book, data, at)
    assert n.tolist() == [3] and spans == [[]] and items == [set()]
