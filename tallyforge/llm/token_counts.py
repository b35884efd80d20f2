"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary with word ends.

The text is normalised and cut to words as the vocabulary file says (NFC, white space to one blank, lower case; letters,
single digits, runs of other characters, English contractions). In a word, BPE has one last token for each prefix: the one
token ending there that stands beside the last token of the prefix before it, where "stands beside" means that the merges
of the two together give back the two. So last tokens and counts of all prefixes follow from left to right, for all new
words of a batch at once, and once more with the word-end mark on the last byte: that is the count if the text stopped here.
A text's count at any prefix is the sum over the words before and the table's entry in the word; nothing is encoded again.

Words are remembered by hash within a worker, in 2^``MEMO`` slots, and forgotten in time: a cache, no limit of what is counted.
Nothing is shuffled. Cases: a null or empty text has no token; special strings in a text are one token each, as the library
has it; repeated rows are answered one by one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import Sorted
from .packing import vocabulary
from .words import mix

MEMO = 20
#: Entries that are kept before all are forgotten.
ENTRIES = 16_000_000
#: Characters of texts that are cut to words at once.
SLICE = 2_000_000
NONE = np.int64(1 << 40)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 0


def _mask(n: np.ndarray) -> np.ndarray:
    return np.arange(n.max(initial=0)) < n[:, None]


class Vocabulary:
    KNOWN = 20  # bits of the slots that remember which pairs stand beside each other

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = (whole := json.load(f))["model"]
        vocab, self.mark = model["vocab"], model["end_of_word_suffix"]
        self.special = [x["content"] for x in whole["added_tokens"]]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        size = max(vocab.values()) + 1
        base = np.full((2, 256), -1, np.int64)
        for c, b in self.byte_of.items():
            base[0, b], base[1, b] = vocab[c], vocab[c + self.mark]
        self.base = base
        # tokens by the rank of the merge that makes them; single bytes have rank -1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs = {}
        for r, (a, b) in enumerate(merges):
            made = vocab.get(a + b)
            pairs[vocab[a], vocab[b]] = (r, made)
            if made is not None and self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
        keys = np.array([a * size + b for a, b in pairs], np.uint64)
        self.size = size
        self.pairs = Sorted(mix(keys), np.array([[r] for r, _ in pairs.values()], np.int64))
        self.known_key, self.known_value = np.zeros(1 << self.KNOWN, np.uint64), np.zeros(1 << self.KNOWN, bool)
        names, ids, ended = [], [], []
        for token, i in vocab.items():
            if token not in self.special and (self.rank[i] >= 0 or token.removesuffix(self.mark) in self.byte_of):
                end = token.endswith(self.mark) and token != self.mark
                names.append(bytes(self.byte_of[c] for c in (token.removesuffix(self.mark) if end else token)))
                ids.append(i)
                ended.append(end)
        ids, ended, n = np.array(ids), np.array(ended), np.array([len(x) for x in names])
        self.longest = int(n.max())
        codes = np.zeros((len(names), self.longest), np.uint64)
        codes[_mask(n)] = np.frombuffer(b"".join(names), np.uint8)
        h = np.zeros(len(names), np.uint64)
        for j in range(self.longest):
            h = np.where(j < n, h * _BASE + codes[:, j] + np.uint64(1), h)
        whole_ok = self._reachable(ids)
        self.tokens = [Sorted(mix(h[(ended == e) & whole_ok]), ids[(ended == e) & whole_ok, None].astype(np.int64)) for e in (False, True)]

    def _reachable(self, ids: np.ndarray) -> np.ndarray:
        """A token that its own merges wouldn't give isn't the last token of anything."""
        made = self.rank[ids] >= 0
        out = np.ones(len(ids), bool)
        out[made] = self._beside(self.left[ids[made]], self.right[ids[made]], self.rank[ids[made]])
        return out

    def _beside(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the seam comes before those that make the two tokens. Undo these one by one, the latest
        first; at each step the two that meet at the seam must not merge earlier than what was just undone."""
        x, y, out, live = x.copy(), y.copy(), np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), NONE, np.int64) if limit is None else limit.copy()
        while len(live):
            a, b = x[live], y[live]
            k = self.pairs.find(mix((a * self.size + b).astype(np.uint64)))
            r = np.where(k >= 0, self.pairs.values[k, 0], NONE)
            bad = r < limit[live]
            out[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            live, a, b, ra, rb = (v[~bad & ((ra >= 0) | (rb >= 0))] for v in (live, a, b, ra, rb))
            first = ra > rb
            # of two equal merges the left one comes first: undoing the right token, an equal rank across the seam wins
            x[live] = np.where(first, self.right[a], a)
            y[live] = np.where(first, b, self.left[b])
            limit[live] = np.where(first, ra, rb + 1)
        return out

    def beside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = mix((x * self.size + y).astype(np.uint64))
        slot = (keys >> np.uint64(64 - self.KNOWN)).astype(np.int64)
        out = self.known_value[slot]
        new = np.flatnonzero(self.known_key[slot] != keys)
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            got = self._beside(x[new[first]], y[new[first]])
            out[new] = got[back]
            slot = slot[new[first]]
            self.known_key[slot], self.known_value[slot] = fresh, got
            taken = self.known_key[slot] == fresh  # two keys in one slot: the last one's value must be its own
            self.known_value[slot[taken]] = got[taken]
        return out

    def prefix_counts(self, words: list[bytes]) -> np.ndarray:
        """For each word, the tokens of each of its byte prefixes taken as a word of its own; all words end to end."""
        n = np.array([len(w) for w in words], np.int64)
        at = np.concatenate(([0], np.cumsum(n)))
        data, out = np.frombuffer(b"".join(words), np.uint8), np.zeros(int(at[-1]), np.int32)
        order = np.argsort(n, kind="stable")
        lo = 0
        while lo < len(order):  # words of like length together: a table of at most 2 M bytes, or one word
            top = max(4, int(n[order[lo]]) * 5 // 4)
            hi = max(lo + 1, min(int(np.searchsorted(n[order], top, "right")), lo + max(1, 2_000_000 // top)))
            part = order[lo:hi]
            mask = _mask(n[part])
            place = at[part, None] + np.arange(mask.shape[1])
            codes = np.zeros(mask.shape, np.uint64)
            codes[mask] = data[place[mask]]
            out[place[mask]] = self._table(codes, n[part])[mask]
            lo = hi
        return out

    def _table(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows of bytes, n of each row; the same form with the counts."""
        w, width = codes.shape
        h = np.zeros((w, width + 1), np.uint64)
        for j in range(width):
            h[:, j + 1] = h[:, j] * _BASE + codes[:, j] + np.uint64(1)
        power = np.ones(self.longest + 1, np.uint64)
        np.multiply.accumulate(np.full(self.longest, _BASE, np.uint64), out=power[1:])
        last, count, ended = np.full((w, width + 1), -1, np.int64), np.zeros((w, width + 1), np.int32), np.zeros((w, width), np.int32)
        for j in range(1, width + 1):
            for end in (0, 1):
                todo = np.flatnonzero(n >= j if end else n > j)
                for size in range(min(j, self.longest), 0, -1):
                    if not len(todo):
                        break
                    i = j - size
                    k = self.tokens[end].find(mix(h[todo, j] - h[todo, i] * power[size]))
                    hit = np.flatnonzero(k >= 0)
                    if not len(hit):
                        continue
                    rows, token = todo[hit], self.tokens[end].values[k[hit], 0]
                    ok = self.beside(last[rows, i], token) if i else np.ones(len(rows), bool)
                    rows, token = rows[ok], token[ok]
                    if end:
                        ended[rows, j - 1] = count[rows, i] + 1
                    else:
                        last[rows, j], count[rows, j] = token, count[rows, i] + 1
                    todo = np.delete(todo, hit[ok])
        return ended


class Counter:
    """Token counts of texts and of their prefixes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))
            kinds[i] = _LETTER if c[0] == "L" else _DIGIT if c[0] == "N" else _SPACE if c[0] == "Z" or chr(i) in "\t\n\v\f\r\x85" else _OTHER
        self.kinds = kinds
        self.cut = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.forget()

    def forget(self) -> None:
        self.known_key, self.known_at = np.zeros(1 << MEMO, np.uint64), np.zeros(1 << MEMO, np.int64)
        self.entries, self.used = np.zeros(1 << 20, np.int32), 0

    @staticmethod
    def normalised(text: str) -> str:
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the texts end to end; first and end place of each word; offsets of the texts."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kind = self.kinds[codes]
        fresh = np.ones(len(codes) + 1, bool)
        fresh[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        fresh[at] = True
        # 's 't 're 've 'm 'll 'd where a word could begin at the apostrophe
        quote = np.flatnonzero((codes == 39) & fresh[:-1])
        if len(quote):
            text_end = at[np.searchsorted(at, quote, "right")]
            follow = np.zeros((3, len(quote)), np.uint32)
            for i in (1, 2):
                ok = quote + i < text_end
                follow[i, ok] = codes[quote[ok] + i]
            one = np.isin(follow[1], [ord(c) for c in "stmd"])
            two = (np.isin(follow[1], [ord("r"), ord("v")]) & (follow[2] == ord("e"))) | ((follow[1] == ord("l")) & (follow[2] == ord("l")))
            cut, size = quote[one | two], np.where(one, 2, 3)[one | two]
            fresh[cut + 1] = False
            fresh[cut + size] = True
        first = np.flatnonzero(fresh[:-1])
        end = np.append(first[1:], len(codes))
        keep = kind[first] != _SPACE
        return codes, first[keep], end[keep], at

    def look_up(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each word's entries begin: one for each of its characters."""
        if not len(first):
            return first
        n = end - first
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        power = np.full(int(n.max()), _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        place = inner + np.repeat(first, n)
        h = mix(np.add.reduceat(mix(codes[place].astype(np.uint64) + np.uint64(1)) * power[inner], begin) ^ n.astype(np.uint64))
        slot = (h >> np.uint64(64 - MEMO)).astype(np.int64)
        out, miss = self.known_at[slot], self.known_key[slot] != h
        if miss.any():
            if self.used > ENTRIES:
                self.forget()
                miss[:] = True
            miss = np.flatnonzero(miss)
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[where]
            n = end[where] - first[where]
            cut = np.concatenate(([0], np.cumsum(n)))
            chars = codes[np.arange(cut[-1]) + np.repeat(first[where] - cut[:-1], n)]
            width = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)).cumsum()  # bytes up to each character
            raw = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            byte = np.concatenate(([0], width))[cut].tolist()
            flat = self.vocabulary.prefix_counts([raw[x:y] for x, y in zip(byte[:-1], byte[1:], strict=True)])
            need = self.used + len(chars)
            if need > len(self.entries):
                self.entries = np.concatenate((self.entries[: self.used], np.zeros(need, np.int32)))
            self.entries[self.used : need] = flat[width - 1]
            starts = cut[:-1] + self.used
            self.used = need
            out[miss] = starts[back]
            slot = slot[where]
            self.known_key[slot] = new
            taken = self.known_key[slot] == new
            self.known_at[slot[taken]] = starts[taken]
        return out

    def _segments(self, texts: list[str | None]) -> tuple[list[str], list[int], np.ndarray]:
        """Normalised texts between special strings, whose text each is of, and special strings in each text."""
        parts, of, special = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            found = self.cut.split(t) if "<|" in t else [t]
            special[i] = len(found) // 2
            for x in found[::2]:
                if x:
                    parts.append(self.normalised(x))
                    of.append(i)
        return parts, of, special

    def totals(self, texts: list[str | None]) -> np.ndarray:
        parts, of, out = self._segments(texts)
        codes, first, end, at = self.words(parts)
        if len(first):
            start = self.look_up(codes, first, end)
            tokens = self.entries[start + (end - first) - 1]
            which = np.array(of)[np.searchsorted(at, first, "right") - 1]
            out += np.bincount(which, tokens, len(texts)).astype(np.int64)
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of the first 1, 2, ... characters of the normalised text (which has no special strings)."""
        low = self.normalised(text or "")
        codes, first, end, _ = self.words([low])
        out = np.zeros(len(low), np.int64)
        if len(first):
            start = self.look_up(codes, first, end)
            total = self.entries[start + (end - first) - 1]
            np.add.at(out, end - 1, total)
            out = np.cumsum(out)
            n = end - first
            inner = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            before = np.concatenate(([0], np.cumsum(total)[:-1]))
            out[inner + np.repeat(first, n)] = np.repeat(before, n) + self.entries[inner + np.repeat(start, n)]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", budgets: tuple[int, ...] = ()) -> DataFrame:
    """df with n_tokens and fits: for each budget, how many characters of the normalised text hold no more tokens."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    names = [common.free_name(df, x) for x in ("n_tokens", "fits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts, n, fits, lo = batch.column(text).to_pylist(), [], [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < SLICE):
                    size += len(texts[hi] or "")
                    hi += 1
                n += c.totals(texts[lo:hi]).tolist()
                lo = hi
            for t in texts:
                p = np.maximum.accumulate(c.prefixes(t)) if budgets else None
                fits.append([int(np.searchsorted(p, b, "right")) for b in budgets])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(fits, pa.list_(pa.int64()))], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{names[0]}` bigint, `{names[1]}` array<bigint>")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return count_tokens(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
