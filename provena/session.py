"""Session helpers: settings used in tests and benches, and the places where lineage is cut."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "provena", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches. On a cluster the session is the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder(application: str) -> str:
    """One temporary folder per local application: the setting itself cannot be changed in a running session."""
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster that is an error, because no
    executor could read another's local files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably and go on from the files: for small results that are used several times."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# Spark removes the shuffle files of a query when it ends, instead of when the driver's garbage collector comes to it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as each write ends: what is written is read back, so nothing needs them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: for wide results of which later
    steps need single columns. Its shuffle files go with the write."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables, as ``written_table`` returned them, that nothing reads any more. Other frames are left alone."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
