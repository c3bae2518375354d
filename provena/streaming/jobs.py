"""The interaction log and the corpus as streams.

Every job is stateless or keeps state bounded by a watermark, writes to a file sink exactly once and can be
stopped and started again from its checkpoint. Chunks are replaced by document in a table of versions; late votes are
resolved on reading.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from provena.operators.chunking import chunk_documents
from provena.operators.quality import tier1
from provena.sources.snapshots import SnapshotTable

SESSION_CAP = 20  # fixed value: queries a session may ask


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, names: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """A growing folder of Parquet files as a stream under an explicit schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, partition_by: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder. ``available_now`` processes what is there and stops."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def dedup_log(log: DataFrame, key: str = "id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each id once within the watermark, however often it is appended."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_feedback(interactions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Votes per day, up and down; a day is written once the watermark has passed it."""
    return (
        interactions.where("feedback is not null")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == -1).alias("down"))
        .select(F.col("w.start").alias("time"), "up", "down")
    )


def window_stats(interactions: DataFrame, size: str = "1 day", slide: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Latency, tokens and cost over sliding windows."""
    return (
        interactions.withWatermark("ts", delay)
        .groupBy(F.window("ts", size, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("retrieval_ms").alias("avg_retrieval_ms"),
            F.max("retrieval_ms").alias("max_retrieval_ms"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("est_cost_usd").alias("cost_usd"),
        )
        .select(F.col("w.start").alias("start"), "n", "avg_retrieval_ms", "max_retrieval_ms", "total_tokens", "cost_usd")
    )


def sessions(queries: DataFrame, user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour", cap: int = SESSION_CAP) -> DataFrame:
    """Closed sessions per user, with a flag for those over the cap."""
    return (
        queries.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("n_queries"))
        .select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_queries", (F.col("n_queries") > cap).alias("over_cap"))
    )


class _SessionCap(StatefulProcessor):
    """Counts the queries of one user's open session. State: how many, and when the last one came; a timer ends the session."""

    def __init__(self, gap_ms: int, cap: int):
        self.gap_ms, self.cap = gap_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        at = got["ts"].to_numpy("datetime64[ms]").astype("int64")
        held = self.open.get() if self.open.exists() else None
        n, last = (held[0], held[1]) if held else (0, None)
        numbers = []
        for t in at.tolist():
            n = n + 1 if last is not None and t - last < self.gap_ms else 1
            last = t if last is None else max(last, t)
            numbers.append(n)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.gap_ms)
        self.open.update((n, last))
        yield pd.DataFrame({"id": got["id"], "user_id": key[0], "ts": got["ts"], "n_in_session": numbers, "over_cap": [n > self.cap for n in numbers]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def capped_queries(queries: DataFrame, gap_ms: int = 30 * 60_000, delay: str = "1 hour", cap: int = SESSION_CAP) -> DataFrame:
    """(id, user_id, ts, n_in_session, over_cap) of every query as it comes: the first one above the cap is flagged in its own batch.

    A session goes on while queries come within ``gap_ms`` of the last one; then a timer drops its state. Queries older than
    the watermark are dropped. Within a batch queries count in the order of time and id. State is two numbers per user with an
    open session; it needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    user = queries.schema["user_id"].dataType.simpleString()
    key = queries.schema["id"].dataType.simpleString()
    schema = f"id {key}, user_id {user}, ts timestamp, n_in_session long, over_cap boolean"
    timed = queries.select("id", "user_id", "ts").withWatermark("ts", delay)
    return timed.groupBy("user_id").transformWithStateInPandas(_SessionCap(gap_ms, cap), schema, "append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def votes(events: DataFrame) -> DataFrame:
    """The vote log (id, value, at); readers take the last vote of an id, see ``latest_feedback``."""
    return events.select("id", "value", "at").where("value is not null")


def apply_votes(interactions: DataFrame, votes_: DataFrame, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(id, ts, feedback, feedback_at): every vote beside the interaction it is about, joined as both arrive.

    A vote counts if it comes ``within`` that time of its interaction. Both sides are watermarked, so an interaction is kept in state
    for as long as a vote on it may still come, and no longer. Readers take the last vote, see ``latest_feedback``.
    """
    asked = interactions.select("id", "ts").withWatermark("ts", delay)
    given = votes(votes_).select(F.col("id").alias("vote_id"), F.col("value").alias("feedback"), F.col("at").alias("feedback_at")).withWatermark("feedback_at", delay)
    near = F.expr(f"feedback_at >= ts AND feedback_at <= ts + INTERVAL {within}")
    return asked.join(given, (F.col("id") == F.col("vote_id")) & near).drop("vote_id")


def upsert_chunks(
    docs: DataFrame, table: SnapshotTable, checkpoint: str, order: Sequence[str] = (), name: str = "chunks", available_now: bool = True
) -> StreamingQuery:
    """Keep ``table`` at the chunks of the last text of every document (doc_id, text, recorded_sha256) that arrives.

    A document that comes again replaces all its chunks, also where it has fewer now; one that fails tier 1 changes nothing.
    Of a document's rows in one batch the last by ``order`` counts. The number of the batch is committed with its chunks,
    so a batch that runs again after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        last = batch
        if order:
            newest = Window.partitionBy("doc_id").orderBy(*[F.desc(c) for c in order])
            last = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        sound = sound_documents(last).persist()
        try:
            table.replace(chunk_documents(sound), sound.select(F.col("doc_id").cast(key_type).alias("doc_id")), name, number)
        finally:
            sound.unpersist()

    key_type = table.schema["doc_id"].dataType
    w = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def sound_documents(docs: DataFrame) -> DataFrame:
    t1 = tier1(F.col("text"), F.sha2("text", 256), F.col("recorded_sha256"))
    return docs.where(t1["extraction_ok"] & t1["integrity_ok"])


def ingest_chunks(docs: DataFrame) -> DataFrame:
    """New documents (doc_id, text, sha256 recorded) to chunks; documents failing tier 1 are left out."""
    return chunk_documents(sound_documents(docs))
