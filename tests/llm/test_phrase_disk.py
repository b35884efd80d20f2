"""What op11 moves and leaves on the disks."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import common, phrases


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath() for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    common.free_shuffles(spark)
    time.sleep(1)
    before = shuffle_files(spark)
    df = common.kept(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    own = shuffle_files(spark) - before
    assert own
    for _ in range(8):  # the JVM may need more than one collection
        common.free_shuffles(spark)
        time.sleep(0.5)
        if not any(map(os.path.exists, own)):
            break
    assert not any(map(os.path.exists, own)) and df.count() == 10


def test_pairs_are_counted_by_short_hashes(spark):
    docs = spark.createDataFrame([("a b a b c", "en"), ("a b; c a b", "en"), ("a b", "de")], "text string, lang string")
    every = np.full(phrases._BITS // 8, 255, np.uint8)
    rows = phrases.pair_counts(docs, every).collect()
    assert sorted(x.n for x in rows) == [1, 1, 1, 1, 4]
    assert all(0 <= x.h < 1 << 40 for x in rows)
