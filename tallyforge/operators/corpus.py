"""Data-set construction: duplicates, contamination, exclusion, splits, samples, folds and set operations."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import scratch


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; unlike dropDuplicates it says which."""
    return df.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(order))).where("__r = 1").drop("__k", "__r")


#: Tasks among which the rows of one hot key are dealt.
SALTS = 8


def with_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the one row of groups of the same key, which may not be null. A hot key's rows go to SALTS tasks."""
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(spread, [key, "__salt"]).drop("__salt")


def text_key(key: Column) -> Column:
    """A hash in place of a long key; null keys are equal to each other."""
    return F.coalesce(F.sha2(key.cast("string"), 256), F.lit(""))


def internal_duplicates(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows that have an earlier one of the same key, and that one's id. Only ids and hashes of keys move."""
    rows = df.select(order, text_key(key).alias("__k"))
    first = rows.groupBy("__k").agg(F.min(order).alias("duplicate_of"), F.max(order).alias("__last")).where(F.col("duplicate_of") < F.col("__last")).drop("__last")
    return with_group(rows, first, "__k").where(F.col(order) > F.col("duplicate_of")).select(order, "duplicate_of")


def exact_matches(df: DataFrame, others: DataFrame, key: Column, other_key: Column, id_: str, other_id: str) -> DataFrame:
    """Rows whose key stands among the others, with the first such other."""
    first = others.groupBy(other_key.alias("__k")).agg(F.min(other_id).alias("external_id"))
    return df.withColumn("__k", key).join(first, "__k").select(id_, "external_id")


def _joined(words: str, k: int):
    return lambda i: F.array_join(F.slice(words, i, k), " ")


#: Bytes of items without an inner word that are broadcast at a time.
SHORT_ITEMS = 1 << 20


def contains_matches(df: DataFrame, items: DataFrame, id_: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(row, item) pairs where the item's normal text stands within the row's. An item may begin and end inside a word of the row,
    so pairs meet on its second and third words (second, if it has three), by an equi-join, and only then are compared in full.
    Items of one or two words have no inner word; they are compared with every row, in blocks of about SHORT_ITEMS bytes."""
    a = df.select(id_, T.collapse(F.col(text)).alias("t")).withColumn("w", F.split("t", " "))
    b = items.select(item_id, T.collapse(F.col(item_text)).alias("u")).where(F.col("u") != "").withColumn("v", F.split("u", " "))
    out = None
    for k, which in ((2, F.size("v") > 3), (1, F.size("v") == 3)):
        n = F.greatest(F.size("w") - (k - 1), F.lit(1))
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), n), _joined("w", k)))
        keyed = b.where(which).select(item_id, "u", F.array_join(F.slice("v", 2, k), " ").alias("k"))
        met = a.select(id_, "t", F.explode(runs).alias("k")).join(keyed, "k").where(F.col("t").contains(F.col("u"))).select(id_, item_id)
        out = met if out is None else out.unionByName(met)
    short = b.where(F.size("v") < 3).select(item_id, "u")
    size = short.agg(F.sum(F.octet_length("u"))).first()[0]
    blocks = -(-size // SHORT_ITEMS) if size is not None else 0
    for block in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64("u", item_id), F.lit(blocks)) == block))
        out = out.unionByName(a.select(id_, "t").join(some, F.col("t").contains(F.col("u"))).select(id_, item_id))
    return out.distinct()


#: Characters of a block of texts that are compared with another block's, on average.
FUZZY_BLOCK = 1 << 15


def fuzzy_best(df: DataFrame, others: DataFrame, id_: str, text: str, other_id: str, other_text: str, cutoff: float, width: int = 8) -> DataFrame:
    """Each row's best Indel ratio among others of cutoff or more. Only texts that can reach it are compared: 200 LCS / (a + b)
    needs lengths within a factor of (200 - c) / c. Texts of both sides are bucketed by the logarithm of their length, and the
    rows look into the buckets within that factor, so the join is by equality. A bucket's texts come in blocks, and what is joined
    is blocks, dealt to SALTS tasks: texts move once for many pairs. Within a pair of blocks a text is aligned with many others in the
    same steps (T.packed_lcs). A common subsequence has no more of a letter than either text, and each letter that is put in or
    taken out changes the numbers of three-letter runs by five in all: pairs with too few letters in common, or (where the cutoff
    is high) whose runs differ by more than it allows, are left out before any is aligned. Neither loses a pair."""
    import math

    spark = df.sparkSession
    reach = math.log((200 - cutoff) / cutoff) if cutoff < 200 else 0.0
    step = max(reach, 0.01) / max(1, width // 4)
    bucket = lambda c: F.floor(F.ln(F.greatest(F.length(c), F.lit(1))) / step).cast("int")
    near = math.ceil(reach / step)

    def written(rows: DataFrame) -> DataFrame:
        rows.write.parquet(at := scratch.path(spark, "texts"))
        return spark.read.schema(rows.schema).parquet(at)

    # of equal others the least id is the answer anyway
    b = written(others.select(other_id, F.col(other_text).alias("u")).where(F.length("u") > 0).groupBy("u").agg(F.min(other_id).alias("other")).withColumn("b", bucket("u")))
    low, high = b.agg(F.min(F.length("u")), F.max(F.length("u"))).first()
    reaches = lambda m, n: 200.0 * F.least(m, n) / (m + n) >= cutoff
    n = F.length("t")
    a = written(df.select(F.col(id_).alias("id"), F.col(text).alias("t")).where(n > 0).where(((n >= F.lit(low)) | reaches(n, F.lit(low))) & ((n <= F.lit(high)) | reaches(n, F.lit(high)))).withColumn("b", bucket("t")))

    def blocks(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, dict[int, int]]:
        """A row for each block: its bucket b, its number, its texts; and the number of blocks of each bucket, of which there are few."""
        sizes = [tuple(x) for x in rows.groupBy("b").agg(F.ceil(F.sum(F.length(value)) / FUZZY_BLOCK).cast("int")).collect()]
        dealt = rows.join(F.broadcast(spark.createDataFrame(sizes, "b int, blocks int")), "b").withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
        return dealt.groupBy("b", "block").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(value).alias("text"))).alias(f"{value}s")), dict(sizes)

    (left, m), (right, n) = blocks(a, "id", "t"), blocks(b, "other", "u")
    pairs = sum(x * n.get(k + i, 0) for k, x in m.items() for i in range(-near, near + 1))
    left = left.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).select(F.explode(F.transform(F.sequence(F.lit(-near), F.lit(near)), lambda i: F.col("b") + i)).alias("b"), "salt", "ts")
    right = right.select("b", "us", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, pairs // 64)
    met = left.join(right, ["b", "salt"]).select("ts", "us").repartition(tasks, F.xxhash64("ts.id", "us.id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for k in range(batch.num_rows) for x in T.best_within(*([(r["id"], r["text"]) for r in batch.column(c)[k].as_py()] for c in (0, 1)), cutoff)]
            ids, external, score = zip(*found, strict=True) if found else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type.value_type[0].type), pa.array(external, batch.schema.field(1).type.value_type[0].type), pa.array(score, pa.float64())], names=["id", "other", "score"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((df, id_), (others, other_id))]
    best = met.mapInArrow(run, f"id {kinds[0]}, other {kinds[1]}, score double").groupBy("id").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("external_id"), F.max("score").alias("score"))
    return best.withColumnRenamed("id", id_)


def contamination(df: DataFrame, others: DataFrame, id_: str, text: str, other_id: str, other_text: str, cutoff: float = 92.0) -> DataFrame:
    """Rows that stand among the others: those of equal normal form (latex_key; reason normalized_exact, the least such other), and of the
    rest those whose normal form has an Indel ratio of cutoff or more to one (reason fuzzy, the best; ties to the least id).
    Null and blank texts are no match."""
    a = df.select(F.col(id_), T.latex_key(F.col(text)).alias("t")).where(F.length("t") > 0)
    b = others.select(F.col(other_id), T.latex_key(F.col(other_text)).alias("u")).where(F.length("u") > 0)
    exact = exact_matches(a, b, text_key(F.col("t")), text_key(F.col("u")), id_, other_id)
    near = fuzzy_best(a.join(exact, id_, "left_anti"), b, id_, "t", other_id, "u", cutoff)
    return exact.select(id_, "external_id", F.lit("normalized_exact").alias("reason"), F.lit(100.0).alias("score")).unionByName(near.select(id_, "external_id", F.lit("fuzzy").alias("reason"), "score"))


#: Bytes of text that fuzzy_top broadcasts at most.
FUZZY_BROADCAST = 64_000_000


def fuzzy_top(df: DataFrame, others: DataFrame, id_: str, text: str, other_id: str, other_text: str, k: int = 5) -> DataFrame:
    """Each row's k best others by Indel ratio of the compact keys (ties to the least id), with the token-set ratio of the token
    keys and the ratio of the compact keys' lengths; exact: whether the row's compact key is that other's. Others of one compact
    key are one, the least, with their number as occurrences; rows and others without a letter, digit or CJK character take no
    part. others is broadcast up to FUZZY_BROADCAST bytes of text; beyond, parts of both are compared with each other. Either way
    every pair is: it is meant for a benchmark."""
    keys = lambda c: (T.compact_key(F.col(c)), T.token_key(F.col(c)))
    compact, tokens = keys(other_text)
    right = others.select(other_id, compact.alias("u"), tokens.alias("v")).where(F.length("u") > 0)
    right = right.groupBy("u").agg(F.min(other_id).alias(other_id), F.min_by("v", other_id).alias("v"), F.count("*").alias("occurrences"))
    size = others.agg(F.sum(F.octet_length(other_text))).first()[0] or 0
    right = F.broadcast(right) if size <= FUZZY_BROADCAST else right.hint("shuffle_replicate_nl")
    compact, tokens = keys(text)
    pairs = df.select(id_, compact.alias("t"), tokens.alias("w")).where(F.length("t") > 0).crossJoin(right)
    scored = pairs.withColumn("score", T.fuzzy("t", "u")).withColumn("r", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("score"), other_id))).where(F.col("r") <= k)
    return scored.select(
        id_, other_id, F.col("r").alias("rank"), "score", T.fuzzy_tokens("w", "v").alias("token_score"), T.length_ratio(F.col("t"), F.col("u")).alias("length_ratio"),
        (F.col("t") == F.col("u")).alias("exact"), "occurrences",
    )


#: Ratios from which a best match is of high risk (with the token-set ratio), and from which it is to be reviewed.
HIGH_RISK, HIGH_RISK_TOKENS, REVIEW = 92.0, 95.0, 84.0


def match_risk(top: DataFrame, id_: str) -> DataFrame:
    """top: rows of fuzzy_top. For each row: whether a best match is exact, of high risk, or to be reviewed by hand."""
    best = top.groupBy(id_).agg(F.bool_or("exact").alias("exact_match"), F.max(F.when(F.col("rank") == 1, F.struct("score", "token_score"))).alias("b"))
    high = F.col("exact_match") | ((F.col("b.score") >= HIGH_RISK) & (F.col("b.token_score") >= HIGH_RISK_TOKENS))
    return best.select(id_, "exact_match", high.alias("high_risk"), (high | (F.col("b.score") >= REVIEW)).alias("review"), F.col("b.score").alias("score"), F.col("b.token_score").alias("token_score"))


def excluded(df: DataFrame, reasons: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason (id, reason), and the others with theirs, in order."""
    why = reasons.groupBy(id_).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return df.join(why, id_, "left_anti"), df.join(why, id_)


def audited_split(df: DataFrame, others: DataFrame, id_: str, text: str, other_id: str, other_text: str, stratum: Column, ratios: dict[str, float], seed: str, flagged: float = 92.0, removed: float = 96.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole way from raw rows to splits: rows that stand among the others (``contamination``, from the ratio flagged on), of these
    the exact ones and those of ratio removed or more go, as do later rows of one normal form; the rest is split by stratum. Returns
    the split rows (stratum, split), the rows that went (reasons, in order) and what was found (for review)."""
    spark, at = df.sparkSession, scratch.path(df.sparkSession, "audit")
    contamination(df, others, id_, text, other_id, other_text, flagged).write.parquet(at)
    found = spark.read.parquet(at)
    exact = F.col("reason") == "normalized_exact"
    external = found.where(exact | (F.col("score") >= removed)).select(id_, F.when(exact, "external_exact").otherwise("external_fuzzy").alias("reason"))
    internal = internal_duplicates(df, T.latex_key(F.col(text)), id_).select(id_, F.lit("internal_duplicate").alias("reason"))
    clean, out = excluded(df, external.unionByName(internal), id_)
    return stratified_split(clean, id_, stratum, ratios, seed), out, found


def duplicate_records(df: DataFrame, signature: Column, id_: str, variant: Column) -> DataFrame:
    """A row for each id of a signature of more than one row: with it how many rows, and how many kinds of the variant, the
    signature has. No list of a signature's ids is made, as an empty text may have any number. A null signature is one too."""
    rows = df.select(signature.alias("signature"), F.col(id_), variant.alias("__v")).withColumn("__k", F.coalesce(F.col("signature").cast("string"), F.lit("")))
    kinds = rows.groupBy("__k", "__v").agg(F.count("*").alias("n")).groupBy("__k").agg(F.sum("n").alias("n"), F.count("__v").alias("variants")).where("n > 1")
    return with_group(rows.select("__k", "signature", id_), kinds, "__k").select("signature", id_, "n", "variants")


def split_overlap(df: DataFrame, split: str, key: Column) -> DataFrame:
    """Distinct keys that two splits share, for every pair of splits."""
    k = df.select(split, key.alias("k")).distinct()
    return k.alias("a").join(k.alias("b"), "k").where(F.col(f"a.{split}") < F.col(f"b.{split}")).groupBy(F.col(f"a.{split}").alias("left_split"), F.col(f"b.{split}").alias("right_split")).agg(F.count("*").alias("shared"))


def hashed(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def in_hash_order(df: DataFrame, group: list[str], place: str, h: Column, *ties: str) -> DataFrame:
    """place: each row's number (from 1) in its group, in the order of the hash h (hexadecimal) and ties. Rows are numbered
    within the first three digits of their hash, and the numbers of earlier digits go before: a group of any size is sorted in
    up to 4096 parts. Null is a group like others."""
    rows = df.withColumns({"__g": F.struct(*group) if group else F.lit(0), "__h": h}).withColumn("__lead", F.substring("__h", 1, 3))
    part = Window.partitionBy("__g", "__lead")
    n = rows.groupBy("__g", "__lead").agg(F.count("*").alias("__n"))
    before = n.withColumn("__before", F.sum("__n").over(Window.partitionBy("__g").orderBy("__lead")) - F.col("__n")).drop("__n")
    rows = rows.withColumn("__own", F.row_number().over(part.orderBy("__h", *ties))).join(before, ["__g", "__lead"])
    return rows.withColumn(place, F.col("__before") + F.col("__own")).drop("__g", "__h", "__lead", "__own", "__before")


#: Rows of one group that are put in order in one task, at most, when a sample's last hash is looked for (more only if their hashes are equal).
_EDGE = 4096


def hash_edges(df: DataFrame, group: list[str], take: Column, h: Column) -> DataFrame:
    """group and edge: in the order of the hash h (hexadecimal, digits of one length), the hash of each group's take-th row (the last,
    of fewer). Counts by leading digits narrow it down, three digits a round, until few rows are left between; no group is sorted or
    sent to one task. A group of which nothing is to be taken has no row."""
    rows = df.select(F.struct(*group).alias("g") if group else F.struct(F.lit(0).alias("all")).alias("g"), h.alias("h"), take.cast("bigint").alias("take"))
    # what is left to look at: digits known of each group's edge, rows to take within them, rows there are
    open_ = rows.groupBy("g").agg(F.max("take").alias("left"), F.count("*").alias("n")).where("left > 0").select("g", F.lit("").alias("lead"), F.least("left", "n").alias("left"), "n")
    spark, digits = df.sparkSession, 0
    while digits < 64:
        place = scratch.path(spark, "edges")
        open_.write.parquet(place)
        open_ = spark.read.schema(open_.schema).parquet(place)
        if (open_.agg(F.max("n")).first()[0] or 0) <= _EDGE:
            break
        digits += 3
        inside = rows.join(open_, "g").where(F.col("h").startswith(F.col("lead")))
        bins = inside.groupBy("g", F.substring("h", 1, digits).alias("next"), "left").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("g").orderBy("next"))  # 4096 bins of a group at most
        bins = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("m") < F.col("left")))
        open_ = bins.select("g", F.col("next").alias("lead"), (F.col("left") - F.col("upto") + F.col("m")).alias("left"), F.col("m").alias("n"))
    inside = rows.join(open_.select("g", "lead", "left"), "g").where(F.col("h").startswith(F.col("lead")))
    last = inside.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("place") == F.col("left"))
    return last.select(*[F.col(f"g.{c}").alias(c) for c in group], F.col("h").alias("edge"))


def hash_split(df: DataFrame, id_: str, ratio: float, seed: str) -> DataFrame:
    """in_sample: whether an id is among the round(n ratio) first in hash order (half to even)."""
    h = hashed(seed, F.col(id_))
    ids = df.select(id_).distinct()
    take = round(ids.count() * ratio)
    edge = hash_edges(ids, [], F.lit(take), h).first()
    return df.where(F.col(id_).isNotNull()).withColumn("in_sample", h <= F.lit(edge.edge if edge else ""))


def stratified_split(df: DataFrame, id_: str, stratum: Column, ratios: dict[str, float], seed: str) -> DataFrame:
    """split of each row: in its stratum, in hash order, floors of n x ratio to each split, what is left to the largest
    remainders (ties by hash of split and stratum)."""
    names = list(ratios)
    s = df.withColumn("stratum", stratum)
    size = s.groupBy("stratum").agg(F.count("*").alias("n"))
    shares = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("name"), F.lit(v).alias("ratio")) for i, (k, v) in enumerate(ratios.items())])
    x = size.select("stratum", "n", F.inline(shares)).withColumn("exact", F.col("n") * F.col("ratio")).withColumn("floor", F.floor("exact"))
    w = Window.partitionBy("stratum")
    by = w.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), hashed(seed, F.col("name"), F.col("stratum")))
    x = x.withColumn("left", F.col("n") - F.sum("floor").over(w)).withColumn("extra", (F.row_number().over(by) <= F.col("left")).cast("bigint"))
    x = x.withColumn("upto", F.sum(F.col("floor") + F.col("extra")).over(w.orderBy("i")))
    bounds = x.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "upto"))), lambda b: b["upto"]).alias("bounds"))
    at = in_hash_order(s, ["stratum"], "place", hashed(seed, F.col(id_)), id_).join(bounds, "stratum")
    which = F.size(F.filter("bounds", lambda b: b < F.col("place")))
    return at.withColumn("split", F.get(F.array(*[F.lit(n) for n in names]), which)).drop("place", "bounds")


def folds(df: DataFrame, dataset: str, id_: str, k: int, seed: str) -> DataFrame:
    """Fold of each id: its place in hash order within its data set, modulo k."""
    ids = in_hash_order(df.select(dataset, id_).distinct(), [dataset], "__place", hashed(seed, F.col(dataset), F.col(id_)), id_)
    return ids.withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__place")


def sample_groups(df: DataFrame, dataset: str, id_: str, n: int, seed: str) -> DataFrame:
    """All rows of the n first ids in hash order of each data set."""
    by = Window.partitionBy(dataset).orderBy(hashed(seed, F.col(dataset), F.col(id_)))
    ids = df.select(dataset, id_).distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= n).drop("r")
    return df.join(ids, [dataset, id_], "left_semi")


def capped_pairs(cand: DataFrame, cap: int, seed: str) -> DataFrame:
    """At most cap (right, wrong) pairs of each question, the first in hash order. A question's candidates meet in one row, and of its
    pairs only cap are held at a time; no other pair becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, p, q = [], [], []
            for i, (name, right, wrong) in enumerate(zip(b.column("name").to_pylist(), b.column("right").to_pylist(), b.column("wrong").to_pylist(), strict=True)):
                pairs = ((hashlib.sha256(f"{seed}|{name}|{x}|{y}".encode()).digest(), x, y) for x in right for y in wrong)
                for _, x, y in heapq.nsmallest(cap, pairs):
                    of.append(i), p.append(x), q.append(y)
            yield pa.RecordBatch.from_arrays([b.column("question_uid").take(pa.array(of, pa.int64())), pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["question_uid", "p", "q"])

    sides = cand.groupBy("question_uid").agg(*[F.collect_list(F.when(F.col("label") == y, F.col("candidate_index").cast("bigint"))).alias(n) for n, y in (("right", 1), ("wrong", 0))])
    rows = sides.where((F.size("right") > 0) & (F.size("wrong") > 0)).withColumn("name", F.col("question_uid").cast("string"))
    return rows.mapInArrow(run, f"question_uid {cand.schema['question_uid'].dataType.simpleString()}, p bigint, q bigint")


def pair_weights(cand: DataFrame, dataset: Column) -> DataFrame:
    """0.5 / questions of the data set / pairs of the question, scaled to a mean of 1 over pairs. A question has as many pairs as
    right times wrong candidates; one without a pair has no weight."""
    sides = cand.withColumn("dataset", dataset).groupBy("dataset", "question_uid").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    w = sides.where("p > 0 AND q > 0").select("dataset", "question_uid", (F.col("p") * F.col("q")).alias("pairs"))
    total = w.groupBy("dataset").agg(F.count("*").alias("questions"), F.sum("pairs").alias("all_pairs"))
    # the weights of a data set's pairs add up to a half, so their mean over all pairs is known from the number of data sets
    mean = total.agg((F.count("*") * 0.5 / F.sum("all_pairs")).alias("mean"))
    scale = total.crossJoin(F.broadcast(mean)).select("dataset", (0.5 / F.col("questions") / F.col("mean")).alias("scale"))
    return w.join(scale, "dataset").select("dataset", "question_uid", "pairs", (F.col("scale") / F.col("pairs")).alias("weight"))


def shuffled_epochs(df: DataFrame, id_: str, length: int, seed: str) -> DataFrame:
    """Items in a new hash order for each epoch, until there are length of them: position and id."""
    n = df.count()
    epochs = -(-length // n) if n else 0
    e = df.select(id_).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0)))))
    e = in_hash_order(e, ["epoch"], "__place", hashed(seed, F.col("epoch"), F.col(id_)), id_)
    return e.withColumn("position", F.col("epoch") * n + F.col("__place") - 1).where(F.col("position") < length).select("position", id_)


def overlap_matrix(sets: dict[str, DataFrame]) -> DataFrame:
    """For each pair of named sets of one key column, how many keys they share."""
    every = reduce(DataFrame.unionByName, [s.toDF("k").distinct().withColumn("name", F.lit(n)) for n, s in sets.items()])
    a, b = every.toDF("k", "a"), every.toDF("k", "b")
    return a.join(b, "k").groupBy("a", "b").agg(F.count("*").alias("shared"))


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many keys only one of the two has."""
    x, y = a.toDF("k").distinct(), b.toDF("k").distinct()
    j = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), "k", "full")
    return j.agg(F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))
