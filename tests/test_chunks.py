"""Chunk ends as tokens, against a walk over the vocabulary's own offsets."""

import os
import random

import pytest

from tallyforge.functions import text as T
from tallyforge.operators import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def walked(problem, solution, caps):
    """Token by token."""
    before = chunks.TEMPLATE[0] + (problem or "") + chunks.TEMPLATE[1]
    tokens = chunks.spans(PATH, before + (solution or "") + chunks.TEMPLATE[2])
    lines, ends = T.line_spans(solution or ""), []
    for a, b in lines:
        whole = chunks.spans(PATH, solution[a:b])
        for x, y in T.sentence_spans(solution, a, b) if len(lines) == 1 or len(whole) > caps[2] else [(a, b)]:
            own, held = chunks.spans(PATH, solution[x:y]), 0
            for i, (_, e) in enumerate(own):
                held += 1
                if held == (caps[0] if len(lines) == 1 else caps[1]) and i + 1 < len(own):
                    ends.append(x + e)
                    held = 0
            ends.append(y)
    ends = sorted(set(ends))
    found = [next((i for i, (a, b) in enumerate(tokens) if a <= len(before) + e - 1 < b), -1) for e in ends]
    return len(tokens), ends, found


def solutions():
    r = random.Random(3)
    parts = ["So 12.5 = x. ", "Then, ", "日本語の文。", "🙂👩‍👩‍👧", "\n", "\n\n", "ünï ", "<|endoftext|>", " \t", "A new sentence! ", "word " * 30, "\x00", "x" * 40, "#### 7"]
    return [None, "", " \n ", "one", "🙂" * 50, "<|endoftext|>" * 5] + ["".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(60)]


@pytest.mark.parametrize("caps", [(64, 128, 128), (3, 5, 8)])
def test_ends_and_places(spark, caps):
    rows = [(i, None if i % 5 == 0 else f"Problem {i} 日?", s) for i, s in enumerate(solutions())]
    got = chunks.chunk_tokens(spark.createDataFrame(rows, "k int, p string, s string").repartition(3), "k", "p", "s", PATH, caps).collect()
    assert {r.k: (r.n_tokens, r.ends, r.places) for r in got} == {k: walked(p, s, caps) for k, p, s in rows}


def test_every_chunk_fits_its_cap(spark):
    """By the vocabulary itself, on all documents of the smallest tables."""
    at = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no tables")
    docs = spark.read.parquet(at).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in chunks.chunk_tokens(docs, "doc_id", "text", "text", PATH, (16, 32, 32)).collect():
        t = texts[r.doc_id] or ""
        assert r.places == sorted(set(r.places)) and all(p >= 0 for p in r.places)
        lines = T.line_spans(t)
        assert (r.ends[-1] if r.ends else None) == (lines[-1][1] if lines else None)


def test_no_token_holds_it():
    assert chunks.places([1, 4, 5, 9], [(0, 2), (2, 3), (4, 6)]) == [0, -1, 2, -1] and chunks.places([], []) == [] and chunks.places([3], []) == [-1]
