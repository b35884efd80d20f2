"""Benchmark decontamination with an FM-index of every training shard.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words, but not none, is one window).
Each partition of the documents is cut into shards of about ``SHARD`` bytes. In a shard, words that no item has can be in
no occurrence, so they end runs; runs shorter than the shortest window go too. The rest is the text of an FM-index:
all windows are searched backwards through it at once, their occurrences are located by sampled suffix positions,
compared with the phrase word by word, and merged to removal spans.

The documents are neither shuffled nor collected. Windows are sent to all executors in blocks of at most ``BLOCK`` bytes of
item text or so, as arrays of word hashes and numbers (under ten bytes for a byte of text); more items mean more passes, each
written to the shared folder before the next, whose spans are merged. A single item longer than that is a block of its own.

Cases: a null or empty text has no words; a null or empty item has no windows; an item without an id marks words but isn't
counted; repeated rows are answered one by one; an empty benchmark leaves all clean; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .fm_index import FMIndex

SHARD = 6_000_000
BLOCK = 16_000_000
#: Windows that are searched at once.
ASKED = 1 << 16
SPANS = "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>"


class Book:
    """The windows of some items: their words as letters of a small alphabet, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        first, end, h = words.words(data, at)
        text_at = words.counts(first, at)
        self.hashes, where, letter = np.unique(h, return_index=True, return_inverse=True)
        self.letters = len(self.hashes) + 1
        self.text = (letter + 1).astype(np.int32)
        self.length = (end - first)[where]
        self.bytes, self.begin = spelled(data, first[where], self.length)
        for lo in range(0, len(h), ASKED):  # words of one hash must be one word
            own = slice(lo, lo + ASKED)
            if wrong_words(self, np.arange(lo, min(lo + ASKED, len(h))), self.text, data, first, end).any():
                raise RuntimeError(f"two words of the items share a hash, at {first[own][0]} or later")
        n = np.diff(text_at)
        count = np.where(n >= window, n - window + 1, n > 0)
        start = np.repeat(text_at[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        size = np.repeat(np.minimum(n, window), count)
        key = np.stack([size.astype(np.uint64), *(window_hashes(self.text, start, size, base) for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))])
        order = np.lexsort(key[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(0)
        phrase = np.empty(len(order), np.int64)
        phrase[order] = np.cumsum(new) - 1
        self.start, self.size = start[order[new]], size[order[new]]
        self.names = sorted({x for x, _ in items if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        name = np.repeat(np.array([-1 if x is None else number[x] for x, _ in items], np.int64), count)
        pair = np.unique(phrase[name >= 0] * max(1, len(self.names)) + name[name >= 0])
        self.item = (pair % max(1, len(self.names))).astype(np.int32)
        self.item_at = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(self.start) + 1))
        self.by_length = {int(k): np.flatnonzero(self.size == k) for k in np.unique(self.size)}
        self.shortest = min(self.by_length, default=0)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray))

    def letters_of(self, h: np.ndarray) -> np.ndarray:
        """0 for a word that no window has."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k + 1, 0).astype(np.int32)

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and letters of the windows, of one length and a bounded number at a time."""
        for k, ids in self.by_length.items():
            for lo in range(0, len(ids), ASKED):
                own = ids[lo : lo + ASKED]
                yield own, self.text[self.start[own][:, None] + np.arange(k)].astype(np.int64)

    def items_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of all these windows, and how many each has."""
        n = self.item_at[phrases + 1] - self.item_at[phrases]
        return self.item[np.repeat(self.item_at[phrases] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


def spelled(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of these words end to end, and where each begins."""
    begin = np.cumsum(n) - n
    return words.LOWER[data[np.repeat(first - begin, n) + np.arange(int(n.sum()))]], begin


def window_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """A hash of each window of letters: differences of running sums of letter times base^place, moved to place 0."""
    back = np.uint64(pow(base, -1, 1 << 64))
    up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(text), b, np.uint64)))) for b in (np.uint64(base), back))
    total = np.concatenate(([np.uint64(0)], np.cumsum(words.mix(text.astype(np.uint64) * np.uint64(base)) * up[:-1], dtype=np.uint64)))
    return words.mix((total[start + size] - total[start]) * down[start])


def long_runs(letters: np.ndarray, text_at: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each run of words with letters, within a text, that a window fits into."""
    inside = letters > 0
    edge = np.zeros(len(letters) + 1, bool)
    edge[text_at] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    keep = e - s >= shortest
    return s[keep], e[keep]


def occurrences(book: Book, letters: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word of every place where a phrase occurs."""
    s, e = long_runs(letters, text_at, book.shortest)
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none
    n = e - s
    begin = np.concatenate(([0], np.cumsum(n + 1)))
    text = np.zeros(int(begin[-1]), np.int32)
    place = np.repeat(s - begin[:-1], n) + (where := np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n))
    text[where] = letters[place]
    word_at = np.zeros(len(text), np.int64)
    word_at[where] = place
    index = FMIndex(text, book.letters)
    phrases, places = [none], [none]
    for ids, wanted in book.phrases():
        lo, hi = index.search(wanted)
        n = hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        phrases.append(np.repeat(ids, n))
        places.append(word_at[index.locate(rows)])
    return np.concatenate(phrases), np.concatenate(places)


def wrong_words(book: Book, at: np.ndarray, letters: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the words at these places only share a hash with the item's word: equal hashes aren't proof."""
    n, word = end[at] - first[at], letters[at] - 1
    bad = n != book.length[word]
    own = np.flatnonzero(~bad)
    n, word = n[own], word[own]
    begin = np.concatenate(([0], np.cumsum(n)))
    inner = np.arange(int(begin[-1])) - np.repeat(begin[:-1], n)
    unlike = words.LOWER[data[np.repeat(first[at[own]], n) + inner]] != book.bytes[np.repeat(book.begin[word], n) + inner]
    if len(own):
        bad[own] = np.add.reduceat(unlike, begin[:-1], dtype=np.int64) > 0
    return bad


def shard_hits(book: Book, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple]], list[set]]:
    """For each text: its words, removal spans (first and end word, first and end byte) and items."""
    first, end, hashed = words.words(data, at)
    text_at = words.counts(first, at)
    letters = book.letters_of(hashed)
    phrases, places = occurrences(book, letters, text_at)
    size = book.size[phrases]

    def covered() -> np.ndarray:
        edge = np.bincount(places, minlength=len(first) + 1) - np.bincount(places + size, minlength=len(first) + 1)
        return np.cumsum(edge)[:-1] > 0

    inside = covered()
    hit = np.flatnonzero(inside)
    if (bad := wrong_words(book, hit, letters, data, first, end)).any():
        before = np.zeros(len(first) + 1, np.int64)
        before[hit[bad] + 1] = 1
        before = np.cumsum(before)
        true = before[places + size] == before[places]
        phrases, places, size = phrases[true], places[true], size[true]
        inside = covered()
    items: list[set] = [set() for _ in range(len(at) - 1)]
    if len(places):
        pairs = np.unique((np.searchsorted(text_at, places, "right") - 1) * len(book.size) + phrases)
        item, n = book.items_of(pairs % len(book.size))
        pairs = np.unique(np.repeat(pairs // len(book.size), n) * max(1, len(book.names)) + item)
        for t, k in zip((pairs // max(1, len(book.names))).tolist(), (pairs % max(1, len(book.names))).tolist(), strict=True):
            items[t].add(book.names[k])
    edge = np.zeros(len(inside) + 1, bool)
    edge[text_at] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    spans: list[list[tuple]] = [[] for _ in items]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    t = np.searchsorted(text_at, s, "right") - 1
    for k, *span in zip(t.tolist(), (s - text_at[t]).tolist(), (e - text_at[t]).tolist(), (first[s] - at[t]).tolist(), (end[e - 1] - at[t]).tolist(), strict=True):
        spans[k].append(tuple(span))
    return np.diff(text_at), spans, items


def merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for x in sorted(spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = (*out[-1][:1], max(out[-1][1], x[1]), out[-1][2], max(out[-1][3], x[3]))
        else:
            out.append(tuple(x))
    return out


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= SHARD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(df: DataFrame, book: Broadcast, text: str, out: tuple[str, str, str]) -> DataFrame:
    n_words, spans_col, items_col = out
    first_pass = spans_col not in df.columns
    names = [*df.columns, *out] if first_pass else df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, text):
            n, spans, items = shard_hits(book.value, *words.utf8(shard.column(text)))
            if not first_pass:
                old_spans, old_items = shard.column(spans_col).to_pylist(), shard.column(items_col).to_pylist()
                spans = [merged([*x, *(tuple(y.values()) for y in o)]) for x, o in zip(spans, old_spans, strict=True)]
                items = [x | set(o) for x, o in zip(items, old_items, strict=True)]
            fields = ("first_word", "end_word", "first_byte", "end_byte")
            columns = {c: shard.column(c) for c in shard.column_names} | {
                n_words: pa.array(n, pa.int64()),
                spans_col: pa.array([[dict(zip(fields, y, strict=True)) for y in x] for x in spans], pa.list_(pa.struct([(f, pa.int64()) for f in fields]))),
                items_col: pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            yield from pa.table([columns[c] for c in names], names=names).to_batches(max_chunksize=1024)

    new = "".join(f", `{c}` {kind}" for c, kind in zip(out, ("bigint", SPANS, "array<string>"), strict=True)) if first_pass else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + new
    return df.mapInArrow(run, schema)


def blocks_of(benchmark: DataFrame, item_text: str) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0) // BLOCK))


def books(benchmark: DataFrame, item_id: str, item_text: str, window: int, blocks: int) -> Iterator[Broadcast]:
    """The windows of all items, by blocks of BLOCK bytes or so."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Book([(x.id, x.text) for x in part.collect()], window))


def find_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """df with n_words, spans (words and bytes to remove, merged) and items (ids as strings, sorted)."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    out = tuple(common.free_name(df, x) for x in ("n_words", "spans", "items"))
    blocks = blocks_of(benchmark, item_text)
    for k, book in enumerate(books(benchmark, item_id, item_text, window, blocks)):
        df = _scan(df, book, text, out)
        if k + 1 < blocks:  # else all books and passes would meet in one task
            df = common.kept(df, "decontamination-pass")
    return df


def without_spans(book: Book, texts: list[bytes]) -> list[bytes]:
    """Texts without their spans, a line feed in place of each; again, as long as what comes together makes a window."""
    out, live = list(texts), list(range(len(texts)))
    while live:
        at = np.concatenate(([0], np.cumsum([len(out[i]) for i in live]))).astype(np.int64)
        _, spans, _ = shard_hits(book, np.frombuffer(b"".join(out[i] for i in live), np.uint8), at)
        changed = [(i, x) for i, x in zip(live, spans, strict=True) if x]
        for i, found in changed:
            edges = [0, *(k for x in found for k in x[2:]), len(out[i])]
            out[i] = b"\n".join(out[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        live = [i for i, _ in changed]
    return out


def _cut(df: DataFrame, book: Broadcast, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, text):
            _, spans, _ = shard_hits(book.value, *words.utf8(shard.column(text)))
            hit = np.array([bool(x) for x in spans])
            if hit.any():
                k, old = shard.schema.get_field_index(text), shard.column(text).combine_chunks()
                new = without_spans(book.value, [old[i].as_py().encode("utf-8", "surrogatepass") for i in np.flatnonzero(hit).tolist()])
                new = pa.array([x.decode("utf-8", "replace") for x in new], old.type)
                shard = shard.set_column(k, shard.schema.field(k), pc.replace_with_mask(old, pa.array(hit), new))
            yield from shard.to_batches(max_chunksize=1024)

    return df.mapInArrow(run, df.schema)


def remove_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """df with all removal spans cut out of the text; texts without any stay as they are."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    blocks = blocks_of(benchmark, item_text)
    for turn in range(1 if blocks == 1 else 2):  # a cut of a later block may bring together a window of an earlier one
        for k, book in enumerate(books(benchmark, item_id, item_text, window, blocks)):
            df = _cut(df, book, text)
            if blocks > 1 and (turn, k) != (1, blocks - 1):
                df = common.kept(df, "decontamination-pass")
    return df


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, common.read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x.end_word - x.first_word)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Windows as strings of words; a document word is hit if it lies in any place where a window stands.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
hits AS (
  SELECT p.doc_id, p.i, p.k, win.item
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)) p
  JOIN win USING (k, g)),
hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
