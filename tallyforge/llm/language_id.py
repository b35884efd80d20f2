"""Language ID by interpolated Kneser-Ney character models.

One model of n-grams up to ``order`` for each language, fitted on at most ``train_docs`` documents and ``train_chars`` letters
of it (taken in the order of a hash of the key, so the sample is random and stable; of a text longer than a tenth of these
letters its first tenth, so that no single one ends the sample); a fifth of the sample calibrates. The
n-grams of all languages stand in one sorted array of hashes for each order, with a column of log probabilities for each
language: one search finds an n-gram's probability in all of them. A missing n-gram backs off through the sorted array of
contexts. The language of least cross-entropy for each letter wins.

Rejection is calibrated on the fifth of the sample that the models aren't fitted on. A language's own texts (labelled so and won
by it, so that wrong labels don't count) give a median and, by medians again, a variance that is left in long texts and one
that shrinks with length. In these deviations, the language's limit lies halfway between the quantile ``keep`` of its own
texts and the quantile 1 - ``foreign`` of what other languages' texts get from its model (their median, since many texts are
in two languages); if these overlap, at the former. The shares beyond the limit of both are kept beside it. A document is rejected if it has no letter or if its least
cross-entropy is beyond the limit of that language.

Whole texts are scored in slices; nothing is shuffled. Cases: null or letterless text is "und" with score 0 and rejected;
rows are answered one by one, so repeats don't matter; without labelled rows every answer is "und"; ties go to the language
that sorts first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .words import _GRAM, mix

UNKNOWN = "und"
CHI2 = 0.4549
#: Code points that are scored at once.
SLICE = 500_000
#: Characters of all languages' samples together, which are collected.
TOTAL = 64_000_000


def letter_table() -> np.ndarray:
    return np.packbits(np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)]))


def hashes(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n codes that end at each place of at."""
    out = np.full(len(at), n * 7919, np.uint64)
    for i in range(n):
        out += codes[at - i] * _GRAM[i]
    return mix(out)


class Sorted:
    """A sorted array of hashes with rows of values; the hash's top bits give where to begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.values = np.vstack((values[order], np.zeros((1, values.shape[1]), values.dtype))) if len(keys) else np.zeros((1, values.shape[1]), values.dtype)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.begin = np.searchsorted(self.keys[:-1], np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        at = self.begin[keys >> self.shift].astype(np.int64)
        live = np.flatnonzero(self.keys[at] < keys)
        while len(live):
            at[live] += 1
            live = live[self.keys[at[live]] < keys[live]]
        return np.where((self.keys[at] == keys) & (at < len(self.keys) - 1), at, -1)


def prepared(texts: list[str | None], letters: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with order - 1 blanks before each text, the places of scored codes, and n + 1 offsets into these."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letters[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (of[1:] == of[:-1])  # a blank after a letter: the word's end
    of = of[keep]
    at = np.arange(len(of)) + (order - 1) * (of + 1)
    out = np.full(len(of) + (order - 1) * len(low), 32, np.uint64)
    out[at] = np.where(letter[keep], codes[keep], 32)
    return out, at, np.searchsorted(of, np.arange(len(low) + 1))


class Model:
    def __init__(self, samples: dict[str, list[str]], order: int = 4, keep: float = 0.995, foreign: float = 0.5):
        self.order, self.letters = order, letter_table()
        table = np.unpackbits(self.letters).astype(bool)
        self.languages = sorted(k for k, v in samples.items() if v)
        fit = {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in samples.items()}
        held = {k: [t for i, t in enumerate(v) if not i % 5 or len(v) < 5] for k, v in samples.items()}
        self._fit([fit[k] for k in self.languages], table)
        self._calibrate([held[k] for k in self.languages], keep, foreign)

    def _calibrate(self, held: list[list[str]], keep: float, foreign: float) -> None:
        size = len(self.languages)
        self.middle, self.spread, self.noise, self.limit, self.false_rejection, self.foreign_rejection = (np.zeros(size) for _ in range(6))
        n, entropy, label = [np.zeros(0, np.int64)], [np.zeros((0, size))], [np.zeros(0, np.int64)]
        for k, texts in enumerate(held):
            length, mean = self.score(texts)
            own = (length > 0) & (mean.argmin(1) == k)
            n.append(length[own]), entropy.append(mean[own]), label.append(np.full(int(own.sum()), k))
        n, entropy, label = np.concatenate(n), np.concatenate(entropy), np.concatenate(label)
        for k in range(size):
            own = label == k
            if not own.any():
                self.limit[k], self.spread[k] = np.inf, 1.0
                continue
            h, length = entropy[own, k], n[own]
            self.middle[k] = np.median(h)
            square, long = (h - self.middle[k]) ** 2, length >= np.median(length)
            self.spread[k] = max(np.median(square[long]) / CHI2, 1e-4)  # the median of a squared normal deviate is CHI2
            self.noise[k] = np.median((length * np.maximum(square - self.spread[k], 0))[~long]) / CHI2 if (~long).any() else 0.0
            away = (entropy[:, k] - self.middle[k]) / self.deviation(k, n)
            most = np.quantile(away[own], keep)
            least = np.quantile(away[~own], 1 - foreign) if (~own).any() else 2 * most
            self.limit[k] = max((most + least) / 2, most, 3.0)
            self.false_rejection[k] = (away[own] > self.limit[k]).mean()
            self.foreign_rejection[k] = (away[~own] > self.limit[k]).mean() if (~own).any() else 1.0

    def deviation(self, k: int | np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.sqrt(self.spread[k] + self.noise[k] / np.maximum(n, 1))

    def _fit(self, texts: list[list[str]], table: np.ndarray) -> None:
        grams: list[list[dict[str, np.ndarray]]] = []
        for own in texts:
            codes, at, _ = prepared(own, table, self.order)
            per, seen = [], None
            for n in range(self.order, 0, -1):
                keys, first, count = np.unique(hashes(codes, at, n), return_index=True, return_counts=True)
                place = at[first]
                if seen is not None:  # below the top: how many letters it follows, not how often it stands
                    count = np.bincount(np.searchsorted(keys, seen), minlength=len(keys)).clip(1)
                # the context ends one code before: the same codes without the last
                per.append({"keys": keys, "count": count.astype(float), "context": hashes(codes, place - 1, n - 1), "rest": hashes(codes, place, n - 1), "place": place})
                seen = per[-1]["rest"]
            grams.append(per[::-1])
        alphabet = len(np.unique(np.concatenate([g[0]["keys"] for g in grams]))) + 1 if grams else 1
        self.base = -np.log(alphabet)
        size = len(grams)
        lower: np.ndarray | None = None
        lower_keys = np.zeros(0, np.uint64)
        self.tables, self.contexts = [], []
        for n in range(self.order):
            keys, first = np.unique(np.concatenate([g[n]["keys"] for g in grams] or [lower_keys]), return_index=True)
            context, rest = (np.concatenate([g[n][x] for g in grams] or [lower_keys])[first] for x in ("context", "rest"))
            contexts = np.unique(context)
            backoff, p = np.ones((len(contexts), size)), np.zeros((len(keys), size))
            below = np.full((len(keys), size), 1 / alphabet) if lower is None else lower[np.searchsorted(lower_keys, rest)]
            of = np.searchsorted(contexts, context)
            for k, g in enumerate(grams):
                count = g[n]["count"]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                where = np.searchsorted(contexts, g[n]["context"])
                total, kinds = np.bincount(where, count, len(contexts)), np.bincount(where, minlength=len(contexts))
                has = total > 0
                backoff[has, k] = d * kinds[has] / total[has]
                mine = np.zeros(len(keys))
                mine[np.searchsorted(keys, g[n]["keys"])] = np.maximum(count - d, 0) / total[where]
                p[:, k] = mine + backoff[of, k] * below[:, k]
            self.tables.append(Sorted(keys, np.log(p).astype(np.float32)))
            self.contexts.append(Sorted(contexts, np.log(backoff).astype(np.float32)))
            lower, lower_keys = p, keys

    def log_p(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the code at each place after those before it, in every language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        live = np.arange(len(at))
        for n in range(self.order, 0, -1):
            found = self.tables[n - 1].find(hashes(codes, at[live], n))
            hit = found >= 0
            out[live[hit]] += self.tables[n - 1].values[found[hit]]
            live = live[~hit]
            if not len(live):
                return out
            context = self.contexts[n - 1].find(hashes(codes, at[live] - 1, n - 1))
            out[live] += np.where(context[:, None] >= 0, self.contexts[n - 1].values[context], 0)
        out[live] += self.base
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scored codes of each text and its cross-entropy in every language."""
        if not hasattr(self, "_table"):
            self._table = np.unpackbits(self.letters).astype(bool)
        codes, at, begin = prepared(texts, self._table, self.order)
        sums = np.zeros((len(texts), len(self.languages)))
        of = np.searchsorted(begin, np.arange(0, len(at), 1), "right") - 1 if len(at) else at
        for lo in range(0, len(at), SLICE):
            p = self.log_p(codes, at[lo : lo + SLICE]).astype(np.float64)
            part = of[lo : lo + SLICE]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            sums[part[cut]] -= np.add.reduceat(p, cut)
        n = np.diff(begin)
        return n, sums / np.maximum(n, 1)[:, None]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def answer(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        n, entropy = self.score(texts)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-(entropy - least[:, None]) * np.minimum(n, 50)[:, None]).sum(1)
        limit = self.middle[best] + self.limit[best] * self.deviation(best, n)
        names = np.array(self.languages, object)[best]
        some = n > 0
        return np.where(some, names, UNKNOWN).tolist(), np.where(some, score, 0.0).tolist(), (~some | (least > limit)).tolist()


def fit(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 4, train_docs: int = 1000, train_chars: int = 2_000_000, keep: float = 0.995) -> Model:
    """Languages are counted over all rows; of each, train_docs documents at most are collected, and train_chars characters in all
    (fewer with more than 32 languages: TOTAL is shared out), a tenth of these at most from one text."""
    rows = df.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(11), F.col(key).cast("string")).alias("draw"), F.col(text).alias("text"))
    count = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a draw below the share that gives half as many again as are wanted: so the sort below sees few rows
    share = F.least(F.lit(1.0), F.lit(1.5 * train_docs) / F.col("n") + 200 / F.col("n"))
    languages = count.count()
    train_chars = max(1, min(train_chars, TOTAL // max(languages, 1)))
    few = rows.join(F.broadcast(count) if languages < 10_000 else count, "lang").where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
    few = few.withColumn("text", F.substring("text", 1, max(1, train_chars // 10)))
    by = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(12), "draw"), "draw", F.length("text"))
    chars = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    picked = few.withColumn("r", F.row_number().over(by)).withColumn("before", F.coalesce(chars, F.lit(0))).where((F.col("r") <= train_docs) & (F.col("before") + F.length("text") <= train_chars) | (F.col("r") == 1))
    samples: dict[str, list[str]] = {}
    for x in picked.select("lang", "text").orderBy("lang", "r").toLocalIterator():
        samples.setdefault(x.lang, []).append(x.text)
    return Model(samples, order, keep)


def predict(df: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [common.free_name(df, x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, answers = batch.column(text).to_pylist(), ([], [], [])
            lo = 0
            while lo < len(texts):  # some texts at a time, so that memory follows the longest text at most
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < SLICE):
                    size += len(texts[hi] or "")
                    hi += 1
                for have, new in zip(answers, shared.value.answer(texts[lo:hi]), strict=True):
                    have.extend(new)
                lo = hi
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(a, k) for a, k in zip(answers, kinds, strict=True))], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
