"""Words of UTF-8 texts and their 64-bit hashes, over whole Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = np.arange(256)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90)) | (_BYTE >= 128)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are tokenized at once; the temporary arrays take about forty times as much.
SLICE = 1_000_000


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _slices(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about SLICE bytes that go through no word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + SLICE, n)
        if hi < n:
            k = int(np.searchsorted(at, hi, "right")) - 1
            if at[k] > lo:
                hi = int(at[k])
            else:
                while hi < n and IS_WORD[data[hi]]:
                    hi += 1
        yield lo, hi
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and hash of every word; texts don't run into each other."""
    first, end, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in _slices(data, at):
        b = data[lo:hi]
        inside = IS_WORD[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if not len(s):
            continue
        n = e - s
        begin = np.zeros(len(n), np.int64)
        np.cumsum(n[:-1], out=begin[1:])
        inner = np.arange(int(begin[-1] + n[-1]), dtype=np.int64) - np.repeat(begin, n)
        power = _POWERS if n.max() <= len(_POWERS) else _powers(int(n.max()))
        h = np.add.reduceat(_VALUE[b[inside]] * power[inner], begin)
        first.append(s + lo), end.append(e + lo), hashed.append(mix(h ^ n.astype(np.uint64)))
    return np.concatenate(first), np.concatenate(end), np.concatenate(hashed)


def counts(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of each text's words: text i has words[out[i]:out[i + 1]]."""
    return np.searchsorted(first, at, "left")


def word_bytes(text: bytes) -> list[bytes]:
    """The words of one text, lower-cased, as bytes."""
    data = np.frombuffer(text, np.uint8)
    first, end, _ = words(data, np.array([0, len(data)], np.int64))
    low = text.translate(LOWER_BYTES)
    return [low[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by the first of them; the last k - 1 places are missing."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1] * _GRAM[0]
    for i in range(1, k):
        out += h[i : len(h) - k + 1 + i] * _GRAM[i]
    return mix(out)
