"""Phrase collocations by suffix sorting: the counts of all phrases of up to ``max_n`` words from one sort.

Every word of a piece begins a suffix of at most max_n words. Suffixes are shuffled by language and words and sorted in reverse
order of words, so that all suffixes with a common beginning stand together, longer ones first; one pass with a stack of the max_n
open beginnings counts them all. Words that don't occur ``least`` times in their language are in no frequent phrase, nor are pairs of
words that don't: suffixes end before them. The parts of a phrase, all as frequent as itself or more, are joined to it afterwards.

Plan: a task counts equal suffixes before they move. Range partitions by (language, first word, following words) keep a first word
together where it fits, and split one that is too frequent (a third of all suffixes, say) over as many partitions as it fills; only
the beginnings of a partition's first and last suffix can go on in another one, so these few counts are added up afterwards, and all
others are whole. Frequent words and pairs (by hash, pairs by 40 bits of it, counted together if they are equal, which only keeps more) reach the tasks
as maps of ``_BITS`` bits (2^25: 4 MB, at any size; one that shares its bit with a frequent one is kept, which costs a row and
changes nothing). The first of each language are found in two steps, among the first of ``_SALTS`` parts. The shuffles of words and of pairs leave the disks
before the next one begins, and the suffixes once they are counted.

Cases: a null or empty text has no words; a null language is `und`, together with a real `und`. Repeated rows count each. Words are
compared as bytes, with A-Z lower-cased. A text of any length is taken in blocks. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .words import LOWER, mix, utf8

_BITS = 1 << 25
#: Bits of a pair's hash by which it is counted (the last _BITS look it up): fewer bytes to move, and 2^40 are far more than pairs.
_PAIR = np.uint64((1 << 40) - 1)
_SALTS = 64
#: Words that a task looks at together, and bytes of counted rows that it holds before it counts them together.
_BLOCK = 1 << 18
_HELD = 128 << 20
_BYTE = np.arange(256)
_PIECE = np.isin(_BYTE, [ord(x) for x in ".,;:!?\n\x0b\x0c\r"])
_GAP = _PIECE | np.isin(_BYTE, [0x20, 0x09])


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of every word of texts (bytes data, offsets at), and whether the next word goes on its piece."""
    edges, first, end, breaks = at[1:-1], [], [], []
    for lo in range(0, len(data), 1 << 22):
        hi = min(lo + (1 << 22), len(data))
        inside = ~_GAP[data[lo:hi]]
        cut = np.zeros(hi - lo + 1, bool)
        cut[edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi, "right")] - lo] = True
        before = np.concatenate(([lo > 0 and not _GAP[data[lo - 1]]], inside[:-1]))
        after = np.concatenate((inside[1:], [hi < len(data) and not _GAP[data[hi]]]))
        first.append(np.flatnonzero(inside & (~before | cut[:-1])) + lo)
        end.append(np.flatnonzero(inside & (~after | cut[1:])) + lo + 1)
        breaks.append(np.flatnonzero(_PIECE[data[lo:hi]]) + lo)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    first, end = np.concatenate(first), np.concatenate(end)
    breaks = np.sort(np.concatenate((*breaks, edges)))
    goes_on = np.searchsorted(breaks, end[:-1], "left") == np.searchsorted(breaks, first[1:], "right")
    return first, end, np.append(goes_on, False) if len(first) else np.zeros(0, bool)


def _strings(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words from first to end as an Arrow column, lower-cased."""
    size = end - first
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data[flat]]))


def _blocks(batch: pa.RecordBatch, ahead: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray, int]]:
    """Codes of words and the words that they stand for, the same of languages, whether each word's piece goes on, and the number of
    words that begin here: blocks hold up to ahead words more, which begin in the next."""
    data, at = utf8(batch.column("text"))
    first, end, goes_on = _words(data, at)
    lang = batch.column("lang").dictionary_encode()
    of = lang.indices.to_numpy().astype(np.int64)[np.searchsorted(at, first, "right") - 1] if len(first) else first
    for lo in range(0, len(first), _BLOCK):
        hi, top = min(lo + _BLOCK, len(first)), min(lo + _BLOCK + ahead, len(first))
        found = _strings(data, first[lo:top], end[lo:top]).dictionary_encode()
        yield found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.string()), of[lo:top], lang.dictionary.cast(pa.string()), goes_on[lo:top], hi - lo


def _counted(rows: list[pa.Table], keys: list[str]) -> pa.Table:
    t = pa.concat_tables(rows)
    return t.group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _together(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Tables of counts, added up as long as they fit."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(x.nbytes for x in held) > _HELD:
            held = [_counted(held, keys)]
            if held[0].nbytes > _HELD // 2:  # few are equal: no use to hold them
                yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _counted(held, keys).to_batches(max_chunksize=1 << 16)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang) -> lang, w, n: occurrences of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for b in batches:
                for code, word, of, langs, _, _ in _blocks(b, 0):
                    key, times = np.unique(of * len(word) + code, return_counts=True)
                    yield pa.table({"lang": langs.take(pa.array(key // len(word))), "w": word.take(pa.array(key % len(word))), "n": pa.array(times, pa.int64())})

        yield from _together(tables(), ["lang", "w"])

    return docs.mapInArrow(run, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def frequent_map(counts: DataFrame, least: int) -> np.ndarray:
    """counts (h, n): bits of the hashes h that n reaches least times; at most _BITS / 64 rows come to the driver, whatever there is."""
    slots = counts.where(F.col("n") >= least).select(F.pmod("h", F.lit(_BITS)).alias("bit")).select(F.shiftright("bit", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b"))
    got = slots.groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(_BITS // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(_BITS)  # _BITS divides 2^64: as pmod of the signed hash
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hashes(code: np.ndarray, word: pa.Array, of: np.ndarray, langs: pa.Array) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word (code) of a language (of)."""
    pairs, back = np.unique(of * len(word) + code, return_inverse=True)
    seeds, word = [xxhash.xxh64_intdigest(x, 42) for x in langs.cast(pa.binary()).to_pylist()], word.cast(pa.binary()).to_pylist()
    at = zip((pairs // len(word)).tolist(), (pairs % len(word)).tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(word[w], seeds[x]) for x, w in at), np.uint64, len(pairs))[back]


def _pairs(h: np.ndarray, goes_on: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word (hashes h) the hash of it and the next, and whether both are known and in one piece."""
    fits = _known(words, h)
    pair = np.zeros(len(h), np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    both = np.zeros(len(h), bool)
    both[:-1] = fits[:-1] & fits[1:] & goes_on[:-1]
    return pair, both


def pair_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """docs (text, lang) -> h, n: occurrences of pairs of known words in a piece, by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for b in batches:
                for code, word, of, langs, goes_on, n in _blocks(b, 1):
                    pair, both = _pairs(_hashes(code, word, of, langs), goes_on, shared.value)
                    h, times = np.unique(pair[:n][both[:n]] & _PAIR, return_counts=True)
                    yield pa.table({"h": pa.array(h.view(np.int64)), "n": pa.array(times, pa.int64())})

        yield from _together(tables(), ["h"])

    return docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, max_n: int) -> DataFrame:
    """docs (text, lang) -> lang, w1 … (null beyond the suffix's end), n: suffixes of two words or more, counted within each task."""
    spark, names = docs.sparkSession, [f"w{i}" for i in range(1, max_n + 1)]
    shared = spark.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value

        def tables() -> Iterator[pa.Table]:
            for b in batches:
                for code, word, of, langs, goes_on, n in _blocks(b, max_n - 1):
                    size, m = len(word), len(code)
                    pair, both = _pairs(_hashes(code, word, of, langs), goes_on, words)
                    both &= _known(pairs, pair)
                    alive, columns = np.ones(m, bool), [of[:n], (code + 1)[:n]]  # code + 1 of each word of a suffix, 0 beyond its end
                    for i in range(1, max_n):
                        w = max(m - i, 0)
                        alive, before = np.zeros(m, bool), alive
                        alive[:w] = before[:w] & both[i - 1 : i - 1 + w]
                        column = np.zeros(m, np.int64)
                        column[:w] = np.where(alive[:w], code[i : i + w] + 1, 0)
                        columns.append(column[:n])
                    some = columns[2] > 0
                    if not some.any():
                        continue
                    columns = [c[some] for c in columns]
                    rank = columns[0]
                    for c in columns[1:]:
                        _, rank = np.unique(rank * (size + 1) + c, return_inverse=True)  # both below the number of words here
                    _, at, times = np.unique(rank, return_index=True, return_counts=True)
                    yield pa.table({"lang": langs.take(pa.array(columns[0][at]))} | {x: word.take(pa.array(c[at] - 1, mask=c[at] == 0)) for x, c in zip(names, columns[1:], strict=True)} | {"n": pa.array(times, pa.int64())})

        yield from _together(tables(), ["lang", *names])

    return docs.mapInArrow(run, f"lang string, {', '.join(f'{x} string' for x in names)}, n bigint")


def prefix_counts(rows: DataFrame, max_n: int, least: int) -> DataFrame:
    """Sorted suffixes -> lang, phrase, k (its words), n and whole: whether n is all, as for every phrase that no other partition can
    have. Whole counts below least are left out; single words aren't counted."""
    names = [f"w{i}" for i in range(1, max_n + 1)]

    def differs(x: pa.Array) -> np.ndarray:
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        return ~(pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False)))

    def row(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(x)[i].as_py() for x in ("lang", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [words, count, whether no other partition can have it] of each open beginning, by length
        begin, last = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            lang, phrase, k, n, whole = zip(*found, strict=True) if found else ([],) * 5
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(whole, pa.bool_())], names=["lang", "phrase", "k", "n", "whole"])

        def done(words: tuple, n: int, whole: bool) -> list[tuple]:
            return [(words[0], " ".join(words[1:]), len(words) - 1, n, whole)] if n >= least or not whole else []

        for b in batches:
            if not b.num_rows:
                continue
            n, found, begin = b.column("n").to_numpy(), [], begin or row(b, 0)
            here, new = row(b, 0), differs(b.column("lang"))
            for k in range(1, max_n + 1):
                new = new | differs(b.column(names[k - 1]))
                if k == 1:  # single words are counted before
                    continue
                has = pc.is_valid(b.column(names[k - 1])).to_numpy(zero_copy_only=False)
                start = np.concatenate(([0], np.flatnonzero(new) + 1))
                total = np.add.reduceat(np.where(has, n, 0), start)
                # what was open before goes on, or is done
                held = next((x for x in stack if len(x[0]) == k + 1), None)
                if held is not None:
                    stack.remove(held)
                    if held[0] == here[: k + 1]:
                        total[0] += held[1]
                    else:
                        found += done(held[0], held[1], held[2])
                at = np.flatnonzero(has[start])  # a beginning of fewer than k words has null here
                if len(at) and at[-1] == len(start) - 1:  # the last one stays open
                    words = row(b, int(start[-1]))[: k + 1]
                    stack.append([words, int(total[-1]), words != begin[: k + 1]])
                    at = at[:-1]
                first = here[: k + 1] == begin[: k + 1]
                for i in at[(total[at] >= least) | ((at == 0) & first)]:
                    words = row(b, int(start[i]))[: k + 1]
                    found += done(words, int(total[i]), not (first and i == 0))
            yield out(found)
        yield out([x for words, n, _ in stack for x in done(words, n, False)])

    return rows.mapInArrow(run, "lang string, phrase string, k int, n bigint, whole boolean")


def phrase_counts(docs: DataFrame, max_n: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang) -> f (lang, phrase, k, n), occurrences of every phrase of 1 to max_n words that occurs least times, and
    totals (lang, n), all words."""
    spark = docs.sparkSession
    words = common.kept(word_counts(docs), "words")
    common.free_shuffles(spark)
    known = frequent_map(words.select(F.xxhash64("lang", "w").alias("h"), "n"), least)
    pairs = frequent_map(pair_counts(docs, known), least)
    common.free_shuffles(spark)  # of the pairs: as large as all that follows
    at = common.scratch(spark, "suffixes")
    rows = common.kept(suffixes(docs, known, pairs, max_n), "suffixes", at)
    order = [F.col(x).desc_nulls_last() for x in ("lang", *(f"w{i}" for i in range(1, max_n + 1)))]
    found = common.kept(prefix_counts(rows.repartitionByRange(*order).sortWithinPartitions(*order), max_n, least), "prefixes")
    common.drop_scratch(spark, at)
    parts = found.where(~F.col("whole")).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    singles = words.where(F.col("n") >= least).select("lang", F.col("w").alias("phrase"), F.lit(1).alias("k"), "n")
    f = common.kept(found.where("whole").drop("whole").unionByName(parts).unionByName(singles), "phrases")
    return f, words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 4, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    f, totals = phrase_counts(docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")), max_n, least)
    long = f.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = long.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first, rest = F.array_join(F.slice("w", 1, F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ")
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), first.alias("part")), F.struct(F.lit(False).alias("left"), rest.alias("part")))).alias("s")).select("lang", "phrase", "a", "cut", "s.left", "s.part")
    # a part that very many phrases have meets them in several tasks
    salts = 8
    parts = f.where(F.col("k") < max_n).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = sides.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")).join(parts, ["lang", "part", "salt"])
    cut = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spans = [(i, n) for n in range(2, max_n) for i in range(1, max_n - n + 2)]
    inner = long.where("k > 2").select("lang", F.col("a").alias("by"), F.explode(F.array(*[F.when((F.lit(n) < F.col("k")) & (F.lit(i + n - 1) <= F.col("k")), F.array_join(F.slice("w", i, n), " ")) for i, n in spans])).alias("phrase"))
    inner = inner.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("by").isNull() | (F.col("by").cast("decimal(25,0)") * 100 < F.col("a").cast("decimal(25,0)") * share))
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
t AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM t) WHERE place = 1),
i AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS by
  FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS s FROM c CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < len(w)) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE i.by IS NULL OR 100::HUGEINT * i.by < 80::HUGEINT * b.a)
SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""
