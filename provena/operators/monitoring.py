"""Dashboard tables over the interaction log. Each takes rows of one closed time range, see ``in_range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end; reaches the scan as a pushed filter."""
    t = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(start).cast(t)) & (F.col(ts) <= F.lit(end).cast(t)))


def day(ts: str = "ts") -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def latest_feedback(votes: DataFrame) -> DataFrame:
    """(id, feedback, feedback_at): the last vote of each interaction; of equal times the larger value."""
    return votes.groupBy("id").agg(F.max(F.struct("at", "value")).alias("_v")).select(
        "id", F.col("_v.value").alias("feedback"), F.col("_v.at").alias("feedback_at")
    )


def apply_feedback(interactions: DataFrame, votes: DataFrame) -> DataFrame:
    """Interactions with the verdict of their last vote; null where nobody voted."""
    return interactions.drop("feedback", "feedback_at").join(latest_feedback(votes), "id", "left")


def feedback_daily(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("feedback").isNotNull())
        .groupBy(day().alias("time"))
        .agg(F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == -1).alias("down"))
    )


def latency_series(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").cast("timestamp_ntz").alias("time"), "retrieval_ms", "llm_ms").orderBy("time")


def score_histogram(df: DataFrame, low: float = 0.0, high: float = 1.0, buckets: int = 20) -> DataFrame:
    """Counts of retrieval scores per equal-width bucket; out-of-range scores fall in 0 and buckets+1."""
    s = df.select(F.explode("retrieval_scores").alias("score"))
    return s.groupBy(F.width_bucket("score", F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def source_mix(df: DataFrame) -> DataFrame:
    return df.select(F.explode("source_orgs").alias("org")).groupBy("org").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "org")


def token_cost_series(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ts").cast("timestamp_ntz").alias("time"), "total_tokens", F.col("est_cost_usd").cast("double").alias("est_cost_usd")
    ).orderBy("time")


def citation_quality_series(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").cast("timestamp_ntz").alias("time"), "invalid_marker_count", "unsupported_paragraph_count").orderBy("time")


def citation_quality_daily(df: DataFrame) -> DataFrame:
    """Daily sums and the share of interactions with any invalid marker."""
    return df.groupBy(day().alias("time")).agg(
        F.sum("invalid_marker_count").alias("invalid_markers"),
        F.sum("unsupported_paragraph_count").alias("unsupported_paragraphs"),
        F.avg((F.col("invalid_marker_count") > 0).cast("int")).alias("invalid_rate"),
    )
