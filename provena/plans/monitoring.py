"""Registered queries: the dashboard panels over an interaction log derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import citations as ci
from provena.operators import monitoring as mo
from provena.operators import review as rv
from provena.plans import common as c

QUERIES: dict = {}
SQL: dict[str, str] = {}
START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def as_interactions(e):
    """Events as interactions: a purchase is an up vote, an error a down vote; numbers come from value and k."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("k", k)
    prompt, completion = (F.floor(F.col("k") / 4) * 4).cast("int"), (F.col("k") % 4).cast("int")
    e = e.withColumn("model", F.lit("gpt-5.4-mini")).withColumn("p", prompt).withColumn("q", completion)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        "user_id",
        F.col("value").cast("int").alias("retrieval_ms"),
        (F.col("k") * 10).alias("llm_ms"),
        F.col("k").alias("total_tokens"),
        rv.cost_usd("model", "p", "q").cast("decimal(10,6)").alias("est_cost_usd"),
        F.array(F.lit(1.0) / (F.col("k") + 1), F.lit(1.0) / (F.col("k") + 2)).alias("retrieval_scores"),
        F.array("event_type").alias("source_orgs"),
        (F.col("k") % 3).alias("invalid_marker_count"),
        (F.col("k") % 5).alias("unsupported_paragraph_count"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).alias("feedback"),
    )


def log(spark, sf):
    """The log inside the shown time range. The range is on the event time itself, so the scan is pruned."""
    return as_interactions(mo.in_range(c.table(spark, sf, "events"), START, END))


SQL_LOG = f"""log AS (SELECT event_id AS id, ts, user_id, CAST(trunc(value) AS INTEGER) AS retrieval_ms, k * 10 AS llm_ms, k AS total_tokens,
  CAST((k // 4 * 4) / 1000::DOUBLE * 0.00025 + (k % 4) / 1000::DOUBLE * 0.001 AS DECIMAL(10, 6)) AS cost, 1.0::DOUBLE / (k + 1) AS s1, 1.0::DOUBLE / (k + 2) AS s2, event_type, k % 3 AS inv, k % 5 AS uns,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS feedback FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
rng AS (SELECT * FROM log WHERE ts BETWEEN '{START}' AND '{END}')"""


@register("feedback_daily", f"WITH {SQL_LOG} SELECT date_trunc('day', ts)::TIMESTAMP AS time, count(*) FILTER (feedback = 1) AS up, count(*) FILTER (feedback = -1) AS down FROM rng WHERE feedback IS NOT NULL GROUP BY 1")
def feedback_daily(spark, sf):
    return mo.feedback_daily(log(spark, sf))


SQL_VOTES = "votes AS (SELECT event_id - event_id % 3 AS id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS value, ts AS vat FROM events WHERE event_type IN ('purchase', 'error'))"


def vote_rows(e):
    return e.where(F.col("event_type").isin("purchase", "error")).select(
        (F.col("event_id") - F.col("event_id") % 3).alias("id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(-1).cast("smallint").alias("value"),
        F.col("ts").alias("at"),
    )


@register(
    "feedback_latest",
    f"""WITH {SQL_VOTES}, lst AS (SELECT id, value, vat FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vat DESC, value DESC) AS r FROM votes) WHERE r = 1)
    SELECT e.event_id AS id, CAST(lst.value AS SMALLINT) AS feedback, vat AS feedback_at FROM events e LEFT JOIN lst ON lst.id = e.event_id""",
)
def feedback_latest(spark, sf):
    """Interactions with their last vote; votes go to the first of every three ids."""
    e = c.table(spark, sf, "events")
    return mo.apply_feedback(e.select(F.col("event_id").alias("id")), vote_rows(e))


@register("answer_latency", f"WITH {SQL_LOG} SELECT id, CAST(retrieval_ms + llm_ms AS INTEGER) AS latency_ms FROM rng")
def answer_latency(spark, sf):
    return log(spark, sf).select("id", ci.latency_ms().alias("latency_ms"))


@register("latency_series", f"WITH {SQL_LOG} SELECT ts AS time, retrieval_ms, CAST(llm_ms AS INTEGER) AS llm_ms FROM rng ORDER BY ts")
def latency_series(spark, sf):
    return mo.latency_series(log(spark, sf))


@register(
    "score_histogram",
    f"""WITH {SQL_LOG}, s AS (SELECT unnest([s1, s2]) AS score FROM rng)
    SELECT CAST(CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 21 ELSE floor(score * 20) + 1 END AS BIGINT) AS bucket, count(*) AS n, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score FROM s GROUP BY 1""",
)
def score_histogram(spark, sf):
    h = mo.score_histogram(log(spark, sf))
    return h.withColumn("min_score", F.round("min_score", 9)).withColumn("max_score", F.round("max_score", 9))


@register("source_mix", f"WITH {SQL_LOG} SELECT event_type AS org, count(*) AS count FROM rng GROUP BY 1 ORDER BY 2 DESC, 1")
def source_mix(spark, sf):
    return mo.source_mix(log(spark, sf))


@register("token_cost_series", f"WITH {SQL_LOG} SELECT ts AS time, total_tokens, CAST(cost AS DOUBLE) AS est_cost_usd FROM rng ORDER BY ts")
def token_cost_series(spark, sf):
    return mo.token_cost_series(log(spark, sf))


@register("citation_quality_series", f"WITH {SQL_LOG} SELECT ts AS time, inv AS invalid_marker_count, uns AS unsupported_paragraph_count FROM rng ORDER BY ts")
def citation_quality_series(spark, sf):
    return mo.citation_quality_series(log(spark, sf))


@register(
    "citation_quality_daily",
    f"WITH {SQL_LOG} SELECT date_trunc('day', ts)::TIMESTAMP AS time, CAST(sum(inv) AS BIGINT) AS invalid_markers, CAST(sum(uns) AS BIGINT) AS unsupported_paragraphs, round(avg((inv > 0)::INT), 6) AS invalid_rate FROM rng GROUP BY 1",
)
def citation_quality_daily(spark, sf):
    return mo.citation_quality_daily(log(spark, sf)).withColumn("invalid_rate", F.round("invalid_rate", 6))
