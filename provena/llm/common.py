"""What the operators share: tables, learning splits, bounded samples and components of links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.session import discard, written_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, longer than any column of ``df``: it can meet none of them."""
    return "_" * max(map(len, ["", *df.columns])) + name


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """True for the rows whose crc32 of the key as text falls into ``fold``; a null key is not held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def bounded_sample(df: DataFrame, by: str, key: str, rows: int) -> tuple[DataFrame, dict]:
    """About ``rows`` rows of each value of ``by`` at most, chosen by a hash of ``key``, and the count of each value.

    A value that has more rows is thinned by a hash threshold, so no value is ranked in one task. The values of
    ``by`` are few by contract (classes, languages).
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        if n > rows:
            share = F.when(F.col(by) == F.lit(value), F.lit(rows / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(draw < share), counts


def hash_sample(df: DataFrame, key: str, by: str, values: Sequence, rows: int) -> DataFrame:
    """At most ``rows`` rows of each of the few ``values`` of ``by``: those with the smallest hash of ``key``, ties by key.

    Each task hands on ``rows`` rows at most, so the bound holds and no task reads a whole class.
    """
    draw = F.xxhash64(F.lit("sample"), F.col(key))
    return reduce(DataFrame.unionAll, [df.where(F.col(by) == F.lit(v)).orderBy(draw, key).limit(rows) for v in values])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a, b), for every node with an edge.

    Large-star and small-star alternate: each round hangs the neighbours of a node on its smallest neighbour.
    Each round is a written table, so a lost executor costs one round; nothing is collected but a checksum. Only the last one stays.
    """
    def star(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def checksum(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    e = table = written_table(star(edges.select("a", "b")))
    before = checksum(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = star(large)
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a")
        done, e = table, written_table(star(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        ))
        table = e
        discard(done)
        now = checksum(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    member = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
