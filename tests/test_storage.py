"""Tables in the shared folder."""

import time

from pyspark.sql import functions as F

from quarry import storage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(key)
    rows = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = storage.materialise(rows, "few")
    assert {(r.k, r.n) for r in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert spark.conf.get(key) == was
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not left
    assert rows.count() == 7  # the table can still be computed anew
    storage.release(out)
