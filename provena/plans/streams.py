"""Registered queries: each stream run over what is there (availableNow), read back from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from provena.operators import monitoring as mo
from provena.plans import common as c
from provena.plans import monitoring as pm
from provena.session import shared_folder
from provena.sources.stores import chunk_table
from provena.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def drain(spark, stream):
    """Run a stream to the end of its input and return its sink as a table."""
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = jobs.write_files(stream, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def table_files(sf, name):
    """A table's path for a stream: it is one file or a folder of files, and only a pattern may be either."""
    return f"{sf}/{{{name}.parquet}}"


def event_stream(spark, sf):
    schema = c.table(spark, sf, "events").schema
    return jobs.read_files(spark, table_files(sf, "events"), schema).withColumn("ts", F.col("ts").cast("timestamp"))


def interaction_stream(spark, sf):
    return pm.as_interactions(event_stream(spark, sf))


# A window or session is written when the watermark, the latest event less the delay, has reached its end.
_WM = "(SELECT max(ts) - INTERVAL {} FROM events)"


@register(
    "stream_daily_feedback",
    f"""WITH {pm.SQL_LOG}, wm AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM log WHERE feedback IS NOT NULL), d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS time, count(*) FILTER (feedback = 1) AS up, count(*) FILTER (feedback = -1) AS down FROM log WHERE feedback IS NOT NULL GROUP BY 1)
    SELECT d.* FROM d, wm WHERE time + INTERVAL 1 DAY <= w""",
)
def stream_daily_feedback(spark, sf):
    out = drain(spark, jobs.daily_feedback(interaction_stream(spark, sf)))
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@register(
    "stream_window_stats",
    f"""WITH {pm.SQL_LOG}, r AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS start FROM log)
    SELECT start, count(*) AS n, round(avg(retrieval_ms), 6) AS avg_retrieval_ms, max(retrieval_ms) AS max_retrieval_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM r
    GROUP BY start HAVING start + INTERVAL 1 DAY <= {_WM.format('1 DAY')}""",
)
def stream_window_stats(spark, sf):
    out = drain(spark, jobs.window_stats(interaction_stream(spark, sf)))
    return out.select(
        F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("avg_retrieval_ms", 6).alias("avg_retrieval_ms"),
        "max_retrieval_ms", "total_tokens", F.col("cost_usd").cast("double").alias("cost_usd"),
    )


@register("stream_dedup_log", "SELECT event_id AS id, ts, user_id FROM events")
def stream_dedup_log(spark, sf):
    """The log appended twice, as after a restart without a checkpoint: every id comes out once."""
    one = event_stream(spark, sf).select(F.col("event_id").alias("id"), "ts", "user_id")
    out = drain(spark, jobs.dedup_log(one.unionByName(one)))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(
    "stream_feedback_upsert",
    f"""WITH {pm.SQL_VOTES} SELECT id, CAST(value AS SMALLINT) AS feedback, vat AS feedback_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vat DESC, value DESC) AS r FROM votes) WHERE r = 1""",
)
def stream_feedback_upsert(spark, sf):
    """Votes streamed into the vote log; reading it gives one verdict per interaction."""
    out = drain(spark, jobs.votes(pm.vote_rows(event_stream(spark, sf))))
    return mo.latest_feedback(out).withColumn("feedback_at", F.col("feedback_at").cast("timestamp_ntz"))


@register(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events),
    n AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n_queries FROM n GROUP BY user_id, s)
    SELECT user_id, start, "end", n_queries, n_queries > 20 AS over_cap FROM x WHERE "end" <= {_WM.format('1 HOUR')}""",
)
def stream_sessions(spark, sf):
    out = drain(spark, jobs.sessions(event_stream(spark, sf), gap="6 hours"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@register(
    "stream_session_cap",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS b FROM events),
    n AS (SELECT event_id, user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT event_id AS id, user_id, ts, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS n_in_session,
           row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) > 3 AS over_cap FROM n""",
)
def stream_session_cap(spark, sf):
    """Every query with its number in its user's session, flagged above a cap of three as it comes."""
    own = jobs.stateful_session(spark)
    events = event_stream(own, sf).select(F.col("event_id").alias("id"), "user_id", "ts")
    out = drain(own, jobs.capped_queries(events, gap_ms=12 * 3_600_000, cap=3))
    return spark.read.schema(out.schema).parquet(*out.inputFiles()).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(
    "stream_ingest_chunks",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS} SELECT chunk_id, doc_id, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, sha256(text) AS text_sha256 FROM chunks WHERE n_chars % 13 <> 0""",
)
def stream_ingest_chunks(spark, sf):
    """Documents arriving as files become chunks; those whose recorded hash is wrong stay out. Every third document arrives twice, first
    with its text doubled: the longer version leaves no chunk behind."""
    docs = jobs.read_files(spark, table_files(sf, "documents"), c.table(spark, sf, "documents").schema)
    recorded = F.when(F.col("n_chars") % 13 == 0, F.lit("stale")).otherwise(F.sha2("text", 256))
    now = docs.withColumn("recorded_sha256", recorded).withColumn("sent", F.lit(2))
    before = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" "), "text")).withColumn("sent", F.lit(1))
    before = before.withColumn("recorded_sha256", F.when(F.col("n_chars") % 13 == 0, F.lit("stale")).otherwise(F.sha2("text", 256)))
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    table = chunk_table(spark, f"{base}/chunks", "chunk_id string, doc_id bigint, chunk_index int, char_start int, char_end int, text string", buckets=16)
    for part, sent in (("first", before), ("then", now)):
        jobs.upsert_chunks(sent, table, f"{base}/{part}", ["sent"], part).awaitTermination()
    return table.read().select("chunk_id", "doc_id", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@register(
    "stream_applied_votes",
    f"""WITH {pm.SQL_VOTES} SELECT e.event_id AS id, e.ts, CAST(v.value AS SMALLINT) AS feedback, v.vat AS feedback_at
    FROM votes v JOIN events e ON e.event_id = v.id WHERE v.vat BETWEEN e.ts AND e.ts + INTERVAL 7 DAYS""",
)
def stream_applied_votes(spark, sf):
    """Votes joined to their interactions while both arrive."""
    e = event_stream(spark, sf)
    out = drain(spark, jobs.apply_votes(e.select(F.col("event_id").alias("id"), "ts"), pm.vote_rows(event_stream(spark, sf))))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("feedback_at", F.col("feedback_at").cast("timestamp_ntz"))
