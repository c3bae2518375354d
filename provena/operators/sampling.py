"""Question sets and samples for review. Order is by hash, so a sample does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small, hashed_rank, running

# Targets per stratum, review sample, calibration size, items per category.
STRATUM_TARGETS = {"multi_country": 30, "ooni_methodology": 20, "general": 100}
REVIEW_SAMPLE_SIZE = 25
CALIBRATION_TOTAL = 65
DEPLOYMENT_PER_CATEGORY = 15


def question_set(ground: DataFrame, supplement: DataFrame, refusal: DataFrame) -> DataFrame:
    """One list of questions with ids ``category-NNNN``, numbered from 0 by position within each source list.

    A list of any length is numbered by ranges of its positions, in as many tasks as there are ranges.
    """
    parts = [
        ground.withColumn("expected_behavior", F.lit("answer")),
        supplement.withColumn("category", F.lit("synthesis_supplement")).withColumn("expected_behavior", F.lit("answer")),
        refusal.withColumn("category", F.lit("refusal")),
    ]
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_list", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    numbered = running(rows, ["position"], group=["_list"], number="_n")
    return numbered.withColumn("question_id", F.format_string("%s-%04d", "category", F.col("_n") - 1)).drop("_list", "position", "_n")


def _order_key(seed: int, key: str) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))


def stratified_fixed(df: DataFrame, stratum: str, key: str, targets: Mapping[str, int], seed: int = 42) -> DataFrame:
    """Up to a fixed number per stratum; strata without a target give nothing.

    Ranks above the largest target are cut in every map task before the shuffle, so a stratum with most of the
    rows costs no more than another.
    """
    target = F
    for name, n in targets.items():
        target = target.when(F.col(stratum) == name, F.lit(n))
    d = df.where(F.col(stratum).isin(*targets)).withColumn("_t", target)
    w = Window.partitionBy(stratum).orderBy(F.md5(_order_key(seed, key)), F.col(key))
    top = max(targets.values())
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).where("_r <= _t").drop("_r", "_t")


def per_category(df: DataFrame, category: str, key: str, n: int = DEPLOYMENT_PER_CATEGORY, seed: int = 42) -> DataFrame:
    """``n`` items of every category."""
    w = Window.partitionBy(category).orderBy(F.md5(_order_key(seed, key)), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def review_sample(df: DataFrame, key: str, n: int = REVIEW_SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(_order_key(seed, key)), F.col(key)).limit(n)


def _take(df: DataFrame, stratum: str, key: str, sizes: DataFrame, seed: int) -> DataFrame:
    """Rows of each stratum up to its size in ``sizes`` (stratum, n_take), which may be large."""
    ranked = hashed_rank(df, _order_key(seed, key), [stratum], out="_r")
    return ranked.join(broadcast_if_small(sizes), stratum).where("_r <= n_take").drop("_r", "n_take")


def proportional_sizes(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """Half-even rounding of each stratum's share; the total may drift from ``size``."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    return counts.select(stratum, F.bround(F.lit(size) * F.col("_n") / total, 0).cast("bigint").alias("n_take"))


def stratified_proportional(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    return _take(df, stratum, key, proportional_sizes(df, stratum, size), seed)


def largest_remainder_sizes(df: DataFrame, stratum: str, size: int, first_seen: str) -> DataFrame:
    """Floors of the shares, the rest to the largest fractions; the total is exactly ``size``.

    Equal fractions keep the order in which the strata first appear by ``first_seen``. One row per stratum is
    ranked in one window.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"), F.min(first_seen).alias("_first"))
    whole = Window.partitionBy(F.lit(1))
    raw = F.lit(size) * F.col("_n") / F.sum("_n").over(whole)
    d = counts.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw"))
    d = d.withColumn("_left", F.lit(size) - F.sum("_floor").over(whole))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 12)), F.asc("_first"))
    bonus = F.when(F.row_number().over(w) <= F.col("_left"), 1).otherwise(0)
    return d.select(stratum, (F.col("_floor") + bonus).cast("bigint").alias("n_take"))


def largest_remainder(df: DataFrame, stratum: str, key: str, size: int, first_seen: str, seed: int = 42) -> DataFrame:
    return _take(df, stratum, key, largest_remainder_sizes(df, stratum, size, first_seen), seed)


def calibration_sample(judgments: DataFrame, key: str = "judgment_id", total: int = CALIBRATION_TOTAL, seed: int = 42) -> DataFrame:
    """Every unsupported and partial judgment, then supported ones up to ``total``; ``position`` shuffles them.

    The doubtful judgments are kept whole however many there are. They are numbered by hash ranges, and only
    the supported fill, at most ``total`` rows, passes one sort.
    """
    doubtful = judgments.where(F.col("verdict").isin("unsupported", "partial"))
    n = doubtful.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = F.md5(_order_key(seed, key))
    fill = judgments.where(F.col("verdict") == "supported").orderBy(order, F.col(key)).limit(total)
    w = Window.partitionBy("verdict").orderBy(order, F.col(key))
    fill = fill.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.lit(total) - n).drop("_r")
    return hashed_rank(doubtful.unionByName(fill), _order_key(seed + 1, key), out="position")
