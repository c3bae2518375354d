"""Cross-checks between every copy of corpus state. Each check runs; any row is a disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.ranking import union_all


class DriftError(RuntimeError):
    """Surfaces of the corpus state disagree."""


def one_way(check: str, left: DataFrame, right: DataFrame, problem: str) -> DataFrame:
    return left.select("doc_id").join(right.select("doc_id"), "doc_id", "left_anti").select(
        F.lit(check).alias("check"), "doc_id", F.lit(problem).alias("problem")
    )


def both_ways(check: str, left: DataFrame, right: DataFrame, only_left: str, only_right: str) -> DataFrame:
    return one_way(check, left, right, only_left).unionByName(one_way(check, right, left, only_right))


def counts(check: str, recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded (doc_id, total_chunks) against actual (doc_id, actual_chunks)."""
    j = recorded.select("doc_id", "total_chunks").join(actual.select("doc_id", "actual_chunks"), "doc_id", "full_outer")
    problem = (
        F.when(F.col("actual_chunks").isNull(), F.concat(F.lit("recorded "), F.col("total_chunks").cast("string"), F.lit(" but no chunks exist")))
        .when(F.col("total_chunks").isNull(), F.concat(F.col("actual_chunks").cast("string"), F.lit(" chunks but no chunking block")))
        .when(
            F.col("total_chunks") != F.col("actual_chunks"),
            F.concat(F.lit("recorded "), F.col("total_chunks").cast("string"), F.lit(" but found "), F.col("actual_chunks").cast("string")),
        )
    )
    return j.select(F.lit(check).alias("check"), "doc_id", problem.alias("problem")).where("problem is not null")


def reconcile(
    declared: DataFrame, acquired: DataFrame, included: DataFrame, metadata: DataFrame, derived: DataFrame,
    all_declared: DataFrame, recorded_chunks: DataFrame, actual_chunks: DataFrame,
) -> DataFrame:
    """All checks as (check, doc_id, problem)."""
    return union_all(
        [
            both_ways("declared-vs-acquired", declared, acquired, "declared but not acquired", "acquired but not declared"),
            both_ways("included-vs-metadata", included, metadata, "included but no metadata", "metadata but not included"),
            one_way("derived-vs-declared", derived, all_declared, "derived checksum but not declared"),
            counts("metadata-vs-chunks", recorded_chunks, actual_chunks),
        ]
    )


def require_agreement(problems: DataFrame) -> None:
    n = problems.count()
    if n:
        raise DriftError(f"{n} disagreement(s) between copies of corpus state")
