"""Staged tables: what a write shuffles is gone when it ends, and the setting is as before."""

import os

from pyspark.sql import functions as F

from provena import session


def _shuffle_files(spark) -> int:
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(status.apply(i).getName().startswith("shuffle_") for i in range(status.size()))


def test_a_staged_table_leaves_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(session.SHUFFLE_CLEANUP, "false")
    there = _shuffle_files(spark)
    counts = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = session.written_table(counts)
    assert _shuffle_files(spark) <= there
    assert spark.conf.get(session.SHUFFLE_CLEANUP, "false") == before
    # the frame itself can be read again
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, counts.collect())) == [(k, 100) for k in range(1000)]


def test_a_discarded_table_leaves_no_files_and_other_frames_keep_theirs(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/input")
    given, staged = spark.read.parquet(f"{tmp_path}/input"), session.written_table(spark.range(10))
    files = [f.removeprefix("file://") for f in staged.inputFiles()]
    session.discard(given, staged, staged)
    assert files and not any(os.path.exists(f) for f in files) and given.count() == 10
