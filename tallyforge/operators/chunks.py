"""Ends of a solution's chunks, as characters and as tokens of the conversation that it stands in.

Lines are cut to sentences, these to at most so many tokens (``functions.text.chunk_ends``), here by a byte-level vocabulary's own
offsets: a character that is several tokens ends with the first of them that holds it, and special strings are one token. The whole
conversation is encoded once, since tokens may run over the solution's ends; its tokens' offsets are in order, so that each end
finds its token by a binary search.

Every row is its own unit of work; texts don't move. Cases: a null solution has no chunks, as has a blank one; a null problem is
empty. A character that no token holds (one that the vocabulary drops) has place -1. Only one encoder is made for each worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What stands before the problem, between it and the solution, and after this.
TEMPLATE = ("<|user|>\n", "\n<|assistant|>\n", "<|endoftext|>")


@lru_cache(2)
def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def spans(path: str, text: str) -> list[tuple[int, int]]:
    """First character of each token, and the one behind its last."""
    return _encoder(path).encode(text, add_special_tokens=False).offsets


def places(ends: list[int], tokens: list[tuple[int, int]]) -> list[int]:
    """The first token that holds the character before each end; -1 where none does."""
    first, last = (np.array([t[i] for t in tokens], np.int64) for i in (0, 1))
    target = np.array(ends, np.int64) - 1
    at = np.searchsorted(last, target, "right")
    there = np.append(first, np.iinfo(np.int64).max)[at] <= target
    return np.where(there, at, -1).tolist()


def chunk_tokens(df: DataFrame, key: str, problem: str, solution: str, vocabulary: str, caps: tuple[int, int, int] = (64, 128, 128), template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """key, n_tokens (of the conversation), ends (characters of the solution) and places (tokens of the conversation) of the chunks. caps:
    tokens of a chunk where the solution has one line, where it has more, and from which a line is cut to sentences."""
    single, cap, trigger = caps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends, at = [], [], []
            for p, s in zip(b.column("p").to_pylist(), b.column("s").to_pylist(), strict=True):
                before = template[0] + (p or "") + template[1]
                tokens = spans(vocabulary, before + (s or "") + template[2])
                own = T.chunk_ends(s or "", single, cap, trigger, lambda t: spans(vocabulary, t))
                n.append(len(tokens))
                ends.append(own)
                at.append(places([len(before) + e for e in own], tokens))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int32()), pa.array(ends, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], names=[key, "n_tokens", "ends", "places"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(problem).alias("p"), F.col(solution).alias("s"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens int, ends array<int>, places array<int>")
