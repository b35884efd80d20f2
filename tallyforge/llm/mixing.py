"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

A mix is a share of all words. Each source has a weight, its part of the mix goes by it, but no source gives more than ``repeats``
times its words; what is above goes to the other sources by their weights, until none is above. A source's target is filled by
complete epochs first (every document once for each), then by a part of an epoch: documents have the exponential key
-ln(u) / quality, u a hash of their id, and are taken in order of their key, heavier ones sooner, until the words are spent. The
document in which they end gives its first words only, so that a source's words are its target, rounded down.

Plan: texts move only if they are asked for (``carry``). Documents are written as range partitions of (source, key), sorted, with a
running sum of words within a partition; a table of (partition, source) totals gives each its start, so that a source of any size
is spread over as many partitions as it fills, and none is read by one task. Sources are ranked and reshared as a table too: each
round of resharing is one aggregate of it. Keys are hashes of ids: a rerun, a retry and any number of partitions agree.

Cases: a null text has no words; a document without words is in the mix with none. A null source is one, after all others. Rows that
repeat an id share their key and stand side by side, in order of size. A document without a label, or with a null one, has
quality weight 1; of several labels the mean counts. Rows without an id draw by their text. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window

from . import common

BLANK = r"\x20\x09-\x0D"
#: Bits of the hash that a draw has: all doubles between 0 and 1, but for the ends.
_BITS = 52


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+")).cast("bigint")


def draw(id: Column, text: Column, seed: str) -> Column:
    """An exponential draw for each id; divided by weights, that of weight w is the least with odds of its share in the weights."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))))
    u = (F.conv(F.substring(F.md5(name), 1, _BITS // 4), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << _BITS))
    return -F.log(u)


def _numbered(spark, sources: DataFrame) -> DataFrame:
    """sources (source, words) with place: from 0, by code point, null last. Range partitions are numbered, then their starts."""
    own = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    own = common.kept(own, "sources")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    return own.withColumn("part", part).join(F.broadcast(starts.select("part", F.coalesce("start", F.lit(0)).alias("start"))), "part").select("source", "words", (F.col("start") + inside).alias("place"))


def targets(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2) -> DataFrame:
    """documents (source, size) -> source, words (its own) and target (double). Weights go round by the order of sources; the mix has
    share[0] / share[1] of all words."""
    spark = documents.sparkSession
    own = _numbered(spark, documents.groupBy("source").agg(F.sum("size").alias("words")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    own = common.kept(own.select("source", "words", weight.cast("decimal(38,0)").alias("weight"), (F.col("words").cast("decimal(30,0)") * repeats).cast("decimal(38,0)").alias("most")), "sources")
    total = int(own.agg(F.sum("words")).first()[0] or 0)
    # in units of 1 / share[1] of a word, so that all is whole numbers; level: words for so much weight, of sources that aren't full
    all_, spent, level = total * share[0], None, (0, 1)
    while True:
        got = own.agg(*[F.sum(F.when(_full(level, share[1]), F.col(c))).alias(c) for c in ("most", "weight")], F.sum("weight").alias("all")).first()
        full, held = int(got.most or 0) * share[1], int(got.weight or 0)
        if (full, held) == spent:
            break
        spent, left = (full, held), max(all_ - full, 0)
        level = (left, int(got["all"]) - held) if got["all"] and int(got["all"]) > held else None
    reached = F.col("most").cast("double")
    if level is not None and level[1]:
        part = F.lit(float(level[0])) * F.col("weight").cast("double") / F.lit(float(level[1] * share[1]))
        reached = F.when(_full(level, share[1]), reached).otherwise(F.least(part, reached))
    return own.select("source", "words", reached.alias("target"))


def _full(level: tuple[int, int] | None, unit: int) -> Column:
    """Whether a source would get more than its most at this level (words in units, weight)."""
    if level is None:
        return F.lit(True)
    words, weight = level
    return F.col("most").cast("double") * float(unit * weight) < F.col("weight").cast("double") * float(words)


def _running(rows: DataFrame) -> DataFrame:
    """rows, sorted within partitions, with their partition (part) and the words of the same source before them in it (before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            source, size = b.column("source"), b.column("size").to_numpy().astype(np.int64)
            if pa.types.is_dictionary(source.type):
                source = source.dictionary_decode()
            x, y = source.slice(1), source.slice(0, len(source) - 1)
            same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False) | (pc.is_null(x).to_numpy(zero_copy_only=False) & pc.is_null(y).to_numpy(zero_copy_only=False))
            first = np.concatenate(([True], ~same))
            before = np.cumsum(size) - size
            start = np.flatnonzero(first)
            before -= np.repeat(before[start], np.diff(np.append(start, len(size))))
            if last is not None and last[0] == source[0].as_py():
                before[: start[1] if len(start) > 1 else len(size)] += carry
            last, carry = (source[-1].as_py(),), int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(before)], names=[*b.schema.names, "part", "before"])

    schema = StructType(list(rows.schema.fields)).add("part", IntegerType()).add("before", LongType())
    return rows.mapInArrow(run, schema)


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", qualities: DataFrame | None = None, carry: tuple[str, ...] = (), weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2, seed: str = "mix") -> DataFrame:
    """Columns own (a struct of id and the columns in carry), size, source_size, target, epochs (complete ones) and taken (words).
    qualities: one row (id, weight above 0) for each id that has a weight of its own."""
    spark = df.sparkSession
    common.ship(spark)
    own = F.struct(F.col(id).alias(id), *[F.col(c) for c in carry if c != id])
    base = df.select(own.alias("own"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), draw(F.col(id), F.col(text), seed).alias("key"))
    if qualities is not None:
        known = qualities.toDF("__id", "weight").withColumn("__none", F.lit(0))
        salt = F.when(F.col(f"own.{id}").isNull(), F.pmod(F.xxhash64("key"), F.lit(1 << 20)).cast("int")).otherwise(0)  # null ids don't meet
        base = base.withColumn("__salt", salt).join(known, (F.col(f"own.{id}") == F.col("__id")) & (F.col("__salt") == F.col("__none")), "left")
        base = base.select("own", "source", "size", (F.col("key") / F.coalesce(F.when(F.col("weight") > 0, F.col("weight")), F.lit(1.0))).alias("key"))
    base = common.kept(base, "documents")
    goal = targets(base, weights, share, repeats)
    order = ["source", "key", "size"]
    rows = common.kept(_running(base.repartitionByRange(*order).sortWithinPartitions(*order)), "sorted")
    parts = rows.groupBy("part", "source").agg(F.sum("size").alias("n"))  # a hot source has many parts, a part few sources
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = parts.withColumn("ahead", ahead).join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), "of", "ahead", "words", "target")
    found = rows.join(named, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("words") > 0, F.floor(F.floor("target") / F.col("words"))).otherwise(0)
    left = F.floor("target") - F.col("epochs") * F.col("words") - F.col("ahead") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.least(left, "size"), F.lit(0))
    return found.withColumn("epochs", epochs.cast("bigint")).select("own", "size", F.col("words").alias("source_size"), "target", "epochs", taken.cast("bigint").alias("taken"))


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each time that a document of mix(carry=(text, ...)) is taken: the columns of own and copy (from 0, the last column); the
    copy beyond the complete epochs has the first words only, if the mix ends in it."""
    copy, rest = common.free_name(mixed.select("own.*"), "copy"), (F.col("taken") - F.col("epochs") * F.col("size")).cast("int")
    some = F.col("epochs") + F.when(rest > 0, 1).otherwise(0)
    rows = mixed.withColumn("rest", rest).where(some > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (some - 1).cast("int"))))
    words = F.regexp_extract_all(f"own.{text}", F.lit(f"[{BLANK}]*[^{BLANK}]+"), 0)
    cut = (F.col(copy) == F.col("epochs")) & (F.col("rest") < F.col("size"))
    whole = F.col(f"own.{text}")
    return rows.withColumn("own", F.col("own").withField(text, F.when(cut, F.array_join(F.slice(words, 1, F.greatest("rest", F.lit(1))), "")).otherwise(whole))).select("own.*", copy)


#: A document labelled as good counts as three of no label, one labelled as bad as a third.
GOOD = 3.0


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = labels.groupBy("doc_id").agg(F.pow(F.lit(GOOD), 2 * F.avg("quality") - 1).alias("weight"))
    found = mix(common.read(spark, sf_dir, "documents"), qualities=good)
    return found.select("own.doc_id", "size", "source_size", "target", "taken")


OP12_SQL = f"""
WITH good AS (SELECT doc_id, pow({GOOD}, 2 * avg(quality) - 1) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(quality) > 0),
d AS (SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, {_BITS // 4}) AS BIGINT) + 0.5) / {float(1 << _BITS)}) / coalesce(w, 1.0) AS key
  FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id),
s AS (SELECT source, words, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1)),
-- sources in the order in which they fill; all before the first that isn't full are
o AS (SELECT *, row_number() OVER (ORDER BY words / weight, weight, source) AS i FROM s),
l AS (SELECT *, 1.5 * sum(words) OVER () - coalesce(sum(2 * words) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
e AS (SELECT min(i) AS i FROM l WHERE 2 * words * open >= remains * weight),
t AS (SELECT s.source, s.words, CASE WHEN o.i >= e.i THEN CAST(f.remains AS DOUBLE) * s.weight / CAST(f.open AS DOUBLE) ELSE 2.0 * s.words END AS target
  FROM s JOIN o ON s.source IS NOT DISTINCT FROM o.source CROSS JOIN e LEFT JOIN l f ON f.i = e.i),
p AS (SELECT d.doc_id, size, t.words, target, CASE WHEN t.words > 0 THEN CAST(floor(floor(target) / t.words) AS BIGINT) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(epochs * size + greatest(least(floor(target) - epochs * words - before, size), 0) AS BIGINT) AS taken
FROM p
"""
