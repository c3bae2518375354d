"""Ranking and size checks that hold when one group carries a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import written_table

# Upper bounds on what is broadcast: checked before each use, see ``query_blocks``.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each map partition to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hashed_rank(
    df: DataFrame, key: Column, strata: Sequence[str] = (), out: str = "rank", prefix: int = 3
) -> DataFrame:
    """Exact 1-based rank by md5 of ``key`` inside each stratum, without one task per stratum.

    Rows are cut into 16**prefix hash ranges per stratum. A range is ranked on its own and shifted by the
    number of rows in the ranges before it, which is a running sum over the small table of range counts.
    """
    strata = list(strata)
    h = df.withColumn("_h", F.md5(key)).withColumn("_b", F.substring("_h", 1, prefix)).withColumn("_k", key)
    counts = h.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b") if not strata else Window.partitionBy(*strata).orderBy("_b")
    offsets = counts.select(
        *[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)],
        F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    cond = F.col("_b").eqNullSafe(F.col("_ob"))
    for i, s in enumerate(strata):
        cond = cond & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    w = Window.partitionBy(*strata, "_b").orderBy("_h", "_k")
    return (
        h.join(offsets, cond, "inner")
        .withColumn(out, (F.row_number().over(w) + F.col("_off")).cast("bigint"))
        .drop("_h", "_b", "_k", "_ob", "_off", "_c", *[f"_s{i}" for i in range(len(strata))])
    )


def running(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column] | None = None, group: Sequence[str] = (), number: str = "n"
) -> DataFrame:
    """Exact 1-based ``number`` of every row by ``order`` inside its group, and the ``sums`` over the rows before it, without one task per group.

    Rows are dealt into ranges of the order and numbered where they lie; a range is shifted by what the ranges before it hold, a
    running sum over one row per range and group. The ranges are written first, so that both passes see the same.
    """
    sums, group = dict(sums or {}), list(group)
    by = [*group, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    staged = written_table(ranged.withColumn("_at", F.monotonically_increasing_id()))
    staged = staged.withColumn("_part", F.shiftright("_at", 33))
    per = staged.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"), *[F.sum(e).alias(f"_sum_{name}") for name, e in sums.items()]
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = per.select(
        F.col("_part").alias("_p"), "_first", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["_c", *[f"_sum_{name}" for name in sums]]],
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = staged.join(broadcast_if_small(moved), same).withColumn(number, F.col("_at") - F.col("_first") + F.col("_c_before") + 1)
    if sums:
        inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        for name, e in sums.items():
            out = out.withColumn(name, F.coalesce(F.sum(e).over(inside), F.lit(0)) + F.col(f"_sum_{name}_before"))
    return out.select(*df.columns, number, *sums)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: at most ``max_rows`` narrow rows; otherwise Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_lookup(
    big: DataFrame, dim: DataFrame, key: str, hot: Column, salt_by: str, salts: int = 64, how: str = "inner"
) -> DataFrame:
    """Join ``big`` to ``dim`` (one row per key) when some keys hold a large share of ``big``.

    ``hot`` is a predicate on ``dim`` that marks heavy keys by their share of all rows, which bounds their
    number; that list is broadcast. Rows of heavy keys are spread over ``salts`` join keys by ``salt_by``, and
    the heavy rows of ``dim`` are copied to each.
    """
    heavy = dim.where(hot).select(key, F.lit(True).alias("_hot"))
    left = big.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    right = dim.withColumn(
        "_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.join(right, [key, "_salt"], how).drop("_hot", "_salt")


def query_blocks(
    queries: DataFrame,
    key: str,
    text: str | Column,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> list[DataFrame]:
    """Cut a batch of queries into blocks that are safe to broadcast; together they are the whole batch.

    One pass over the query table alone measures rows and bytes: those of the column ``text``, or the number that an
    expression gives for a row. A normal batch is one block.
    """
    measure = F.octet_length(F.col(text).cast("string")) if isinstance(text, str) else text
    rows, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(measure.cast("long")), F.lit(0))).first()
    n = max(math.ceil(rows / max_rows), math.ceil(size / max_bytes), 1)
    if n == 1:
        return [queries]
    n *= 2  # hash blocks are uneven; half-full blocks keep each one under the bound
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a narrow input: repartition only if the scan has fewer partitions than there are cores.

    A scan of a large table has more partitions than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
