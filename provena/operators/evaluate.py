"""Retrieval metrics: hit rate, reciprocal rank, diversity, confidence intervals, ablations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.ranking import hashed_rank, running, union_all
from provena.operators.chunking import neighbor_chunk_ids
from provena.operators.passages import holding, windows_holding
from provena.session import cut_lineage

# Number of resamples, seed, positions of the interval's order statistics (0-based).
BOOTSTRAP_RESAMPLES = 2000
BOOTSTRAP_SEED = 42
# Groups whose values stand side by side as columns while draws are averaged.
GROUPS_AT_A_TIME = 32


def gold_chunks(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_id) of every chunk that contains a passage verbatim, see ``passages.holding``."""
    return holding(chunks, passages)


def gold_windows(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``gold_chunks`` of the windows of the documents (doc_id, text), without cutting them."""
    held = windows_holding(docs, passages)
    return held.select("query_id", "doc_id", F.format_string("%s-chunk-%04d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"))


def acceptable_chunks(gold: DataFrame) -> DataFrame:
    """Gold chunks and their neighbours: (query_id, chunk_id, strict)."""
    near = gold.select("query_id", F.explode(neighbor_chunk_ids("chunk_id")).alias("chunk_id"), F.lit(False).alias("strict"))
    rows = gold.select("query_id", "chunk_id", F.lit(True).alias("strict")).unionByName(near)
    return rows.groupBy("query_id", "chunk_id").agg(F.max("strict").alias("strict"))


def score_questions(
    questions: DataFrame, results: DataFrame, gold: DataFrame, methods: Sequence[str], top: int = 10
) -> DataFrame:
    """One row per (method, question): ranks of the gold chunk, strict and with neighbours, and diversity.

    ``results`` has method, query_id, chunk_id, doc_id, organization, rank. Every question gets a row for every
    method; one without results or without gold counts as a miss.
    """
    r = results.where(F.col("rank") <= top)
    hits = r.join(acceptable_chunks(gold), ["query_id", "chunk_id"], "left")
    per = hits.groupBy("method", "query_id").agg(
        F.min(F.when(F.col("strict"), F.col("rank"))).alias("strict_rank"),
        F.min(F.when(F.col("strict").isNotNull(), F.col("rank"))).alias("relaxed_rank"),
        F.count_distinct("organization").alias("n_orgs"),
        F.count_distinct("doc_id").alias("n_docs"),
    )
    grid = questions.select("query_id", "category", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    s = grid.join(per, ["method", "query_id"], "left")

    def rr(c: str) -> Column:
        return F.coalesce(F.lit(1.0) / F.col(c), F.lit(0.0))

    return s.select(
        "method",
        "query_id",
        "category",
        F.col("strict_rank").isNotNull().cast("int").alias("hit"),
        rr("strict_rank").alias("rr"),
        F.col("relaxed_rank").isNotNull().cast("int").alias("relaxed_hit"),
        rr("relaxed_rank").alias("relaxed_rr"),
        F.coalesce(F.col("strict_rank") <= 3, F.lit(False)).cast("int").alias("hit_at_3"),
        F.coalesce(F.col("strict_rank") <= 5, F.lit(False)).cast("int").alias("hit_at_5"),
        F.coalesce("n_orgs", F.lit(0)).alias("n_orgs"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
    )


METRICS = {
    "hit_rate": "hit", "mrr": "rr", "relaxed_hit_rate": "relaxed_hit", "relaxed_mrr": "relaxed_rr",
    "hit_rate_at_3": "hit_at_3", "hit_rate_at_5": "hit_at_5", "avg_distinct_orgs": "n_orgs", "avg_distinct_docs": "n_docs",
}


def summarize(scored: DataFrame, methods: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Means per (method, category) and per method as category ``all``; a category without questions has 0.0."""
    grouped = (
        scored.groupingSets([["method", "category"], ["method"]], "method", "category")
        .agg(
            F.grouping("category").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            *[F.avg(src).alias(name) for name, src in METRICS.items()],
        )
        .withColumn("category", F.when(F.col("_all") == 1, "all").otherwise(F.col("category")))
        .drop("_all")
    )
    spark = scored.sparkSession
    grid = spark.createDataFrame([(m, k) for m in methods for k in [*categories, "all"]], "method string, category string")
    return F.broadcast(grid).join(grouped, ["method", "category"], "left").select(
        "method",
        "category",
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in METRICS],
    )


def bootstrap_ci(
    values: DataFrame, group: Sequence[str], value_cols: Sequence[str], id_col: str, resamples: int = BOOTSTRAP_RESAMPLES,
    seed: int = BOOTSTRAP_SEED,
) -> DataFrame:
    """95% percentile interval of the mean per group: one row (group..., metric, n, lo, hi).

    Draw i of resample b takes the value number md5(seed:b:i) mod n, so the draws depend on nothing but the
    data. Draws are rows, shared by all groups of a size; the means are sorted within the
    fixed number of resamples.
    """
    g = list(group)
    ranked = hashed_rank(values, F.col(id_col).cast("string"), g, out="_pos")
    sizes = values.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per method or arm
    ranked = cut_lineage(ranked.select(*g, "_pos", *value_cols))
    parts = []
    # A draw depends on the number of values alone: groups of one size share it, each value a column of its own.
    for n in sorted({r["n"] for r in sizes}):
        alike = [r for r in sizes if r["n"] == n]
        for same in (alike[i : i + GROUPS_AT_A_TIME] for i in range(0, len(alike), GROUPS_AT_A_TIME)):
            mine = [reduce(and_, [F.col(k).eqNullSafe(F.lit(r[k])) for k in g]) for r in same]
            cells = [(i, v) for i in range(len(same)) for v in value_cols]
            wide = ranked.where(reduce(or_, mine)).groupBy("_pos").agg(
                *[F.max(F.when(mine[i], F.col(v))).cast("double").alias(f"_{i}_{v}") for i, v in cells]
            )
            draws = values.sparkSession.range(resamples * n).select(
                F.expr(f"id div {n}").alias("_b"), (F.col("id") % n).alias("_i")
            )
            drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_b"), F.col("_i"))), 1, 8), 16, 10).cast("bigint")
            means = draws.select("_b", (drawn % n + 1).alias("_pos")).join(wide, "_pos").groupBy("_b").agg(
                *[F.avg(f"_{i}_{v}").alias(f"_{i}_{v}") for i, v in cells]
            )
            types = {k: values.schema[k].dataType for k in g}
            each = [
                F.struct(*[F.lit(same[i][k]).cast(types[k]).alias(k) for k in g], F.lit(v).alias("metric"), F.col(f"_{i}_{v}").alias("mean"))
                for i, v in cells
            ]
            parts.append(means.select(F.lit(n).cast("bigint").alias("n"), F.explode(F.array(*each)).alias("_m")).select("_m.*", "n"))
    if not parts:
        empty = values.groupBy(*g).agg(F.lit("").alias("metric"), F.lit(0).cast("bigint").alias("n"))
        return empty.select(*g, "metric", "n", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).where(F.lit(False))
    long = union_all(parts)
    w = Window.partitionBy(*g, "metric").orderBy("mean")
    lo, hi = int(0.025 * resamples) + 1, int(0.975 * resamples)
    at = long.withColumn("_r", F.row_number().over(w)).where(F.col("_r").isin(lo, hi))
    return at.groupBy(*g, "metric").agg(
        F.first("n").alias("n"),
        F.max(F.when(F.col("_r") == lo, F.col("mean"))).alias("lo"),
        F.max(F.when(F.col("_r") == hi, F.col("mean"))).alias("hi"),
    )


def intervals_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def ablation(scored: DataFrame, firing: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Hit rate and MRR per arm on all questions and on those where the boost acts, with wins of the last arm.

    ``scored`` is ``score_questions`` output with the arm as method; ``firing`` has query_id of the subset. Wins,
    losses and ties compare reciprocal ranks of the last arm with the one before it, on the firing subset.
    """
    s = scored.join(firing.select("query_id", F.lit(True).alias("_f")), "query_id", "left")
    both = s.select("*", F.explode(F.when(F.col("_f"), F.array(F.lit("full"), F.lit("firing"))).otherwise(F.array(F.lit("full")))).alias("subset"))
    means = both.groupBy("subset", F.col("method").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr")
    )
    before, last = arms[-2], arms[-1]
    pair = s.where("_f").groupBy("query_id").agg(
        F.max(F.when(F.col("method") == before, F.col("rr"))).alias("b"),
        F.max(F.when(F.col("method") == last, F.col("rr"))).alias("c"),
    )
    wlt = pair.agg(
        F.count_if(F.col("c") > F.col("b")).alias("wins"),
        F.count_if(F.col("c") < F.col("b")).alias("losses"),
        F.count_if(F.col("c") == F.col("b")).alias("ties"),
    ).select(F.lit("firing").alias("subset"), F.lit(last).alias("arm"), "wins", "losses", "ties")
    return means.join(wlt, ["subset", "arm"], "left")


class BoostGuardError(AssertionError):
    """The boost changed a result list it must not touch."""


def require_same_lists(a: DataFrame, b: DataFrame) -> None:
    """Both ranked lists (query_id, rank, chunk_id) must be equal."""
    x, y = (d.select("query_id", "rank", "chunk_id") for d in (a, b))
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise BoostGuardError("lists differ although the boost did not fire")


def diversity(results: DataFrame, top: int = 10) -> DataFrame:
    """Per query: which leg the fused list's documents resemble more, and how many documents it lost to text.

    ``results`` has method (text, vector, hybrid), query_id, doc_id, rank. Sets hold at most ``top`` documents.
    """
    r = results.where(F.col("rank") <= top)
    sets = r.groupBy("query_id").agg(
        *[F.collect_set(F.when(F.col("method") == m, F.col("doc_id"))).alias(m) for m in ("text", "vector", "hybrid")]
    )
    denom = F.greatest(F.size("hybrid"), F.lit(1))
    v = F.size(F.array_intersect("hybrid", "vector")) / denom
    t = F.size(F.array_intersect("hybrid", "text")) / denom
    return sets.select(
        "query_id",
        v.alias("overlap_vector"),
        t.alias("overlap_text"),
        F.when(v > t, "vector").when(t > v, "text").otherwise("tied").alias("closer"),
        (F.size("text") - F.size("hybrid")).alias("gap"),
        F.size("text").alias("text_docs"),
        F.size("hybrid").alias("hybrid_docs"),
        F.size("vector").alias("vector_docs"),
    )


def diversity_counts(per_query: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return per_query.agg(
        F.count_if(F.col("closer") == "vector").alias("closer_to_vector"),
        F.count_if(F.col("closer") == "text").alias("closer_to_text"),
        F.count_if(F.col("closer") == "tied").alias("tied"),
        n.alias("n"),
        F.try_divide(F.count_if(F.col("closer") == "vector"), n).alias("share_vector"),
        F.try_divide(F.count_if(F.col("closer") == "text"), n).alias("share_text"),
    )


def largest_gaps(per_query: DataFrame, k: int = 5) -> DataFrame:
    return per_query.orderBy(F.desc("gap"), F.asc("query_id")).limit(k)


def cross_source_pairs(results: DataFrame) -> DataFrame:
    """Pairs of results of one query from different organizations, the better-ranked one first.

    A result list holds at most the search depth, so the pairs of a query are bounded by it.
    """
    a = results.select("query_id", F.col("rank").alias("rank_a"), F.col("chunk_id").alias("chunk_a"), F.col("organization").alias("org_a"))
    b = results.select("query_id", F.col("rank").alias("rank_b"), F.col("chunk_id").alias("chunk_b"), F.col("organization").alias("org_b"))
    return a.join(b, "query_id").where((F.col("rank_a") < F.col("rank_b")) & (F.col("org_a") != F.col("org_b")))


def spend_budget(per_event: DataFrame, budget: int) -> DataFrame:
    """Split a budget of checks over events in order: (query_id, n_pairs, cap, n_checked, remaining).

    Each event may use the remaining budget divided by the events left, at least one, until nothing is left; events after
    that get no row. Only events with pairs change what remains, and each uses one check at least, so the first
    ``budget`` of them decide everything: their positions and pair counts, two numbers each, are folded on the driver. Positions
    are counted by ranges of the order, not in one task.
    """
    spends = (F.col("n_pairs") > 0).cast("long")
    events = running(per_event.select("query_id", F.col("n_pairs").cast("long").alias("n_pairs")), ["query_id"], {"spent_before": spends}, number="i")
    total = events.count()
    left, steps = budget, [(0, budget)]
    for r in events.where("n_pairs > 0").where(F.col("spent_before") < budget).select("i", "n_pairs").orderBy("i").collect():
        left -= min(max(1, left // (total - r["i"] + 1)), r["n_pairs"])
        steps.append((len(steps), left))
        if left == 0:
            break
    state = per_event.sparkSession.createDataFrame(steps, "spent_before long, remaining long")  # at most budget + 1 rows
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.col("remaining") / (F.lit(total) - F.col("i") + 1)))
    out = events.join(F.broadcast(state), "spent_before").where("remaining > 0").withColumn("cap", cap)
    return out.select(
        "query_id", "n_pairs", F.col("cap").cast("int").alias("cap"), F.least("cap", "n_pairs").cast("int").alias("n_checked"),
        F.col("remaining").cast("int").alias("remaining"),
    )
