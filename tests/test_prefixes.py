"""Numbering by ranges, the budget of checks, ordered tables and the substring join, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.functions.ranking import running
from provena.operators import evaluate as ev
from provena.operators import passages as pa_
from provena.operators import sampling as sm
from provena.sources import stores as st


def plain_budget(pairs, budget):
    out, left = [], budget
    for i, n in enumerate(pairs):
        if left <= 0:
            break
        cap = max(1, left // (len(pairs) - i))
        used = min(cap, n)
        out.append((i, n, cap, used, left))
        left -= used
    return out


@pytest.mark.parametrize("seed,n,budget", [(0, 1, 5), (1, 40, 50), (2, 300, 50), (3, 200, 7), (4, 30, 10_000), (5, 50, 0)])
def test_budget_against_a_plain_walk(spark, seed, n, budget):
    rng = np.random.default_rng(seed)
    pairs = [int(x) for x in rng.choice([0, 0, 1, 2, 9, 400], n)]
    df = spark.createDataFrame(list(enumerate(pairs)), "query_id long, n_pairs long").repartition(5)
    got = sorted(tuple(r) for r in ev.spend_budget(df, budget).collect())
    assert got == plain_budget(pairs, budget)


def test_budget_of_a_million_events(spark):
    """Nearly all events are empty: all get a row while budget is left, none is gathered."""
    df = spark.range(1_000_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 30_000 == 7, 3).otherwise(0).cast("long").alias("n_pairs"))
    out = ev.spend_budget(df, 20)
    last = out.agg(F.count(F.lit(1)).alias("n"), F.sum("n_checked").alias("used"), F.min("remaining").alias("least")).first()
    want = plain_budget([3 if i % 30_000 == 7 else 0 for i in range(1_000_000)], 20)
    assert (last["n"], last["used"]) == (len(want), sum(w[3] for w in want))


def test_budget_without_events(spark):
    assert ev.spend_budget(spark.createDataFrame([], "query_id long, n_pairs long"), 50).isEmpty()


def test_running_numbers_and_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(["x", "y", None][int(rng.choice(3, p=[0.8, 0.15, 0.05]))], i, int(rng.integers(9))) for i in rng.permutation(500).tolist()]
    df = spark.createDataFrame(rows, "g string, at int, v long").repartition(6)
    got = {(r["g"], r["at"]): (r["n"], r["s"]) for r in running(df, ["at"], {"s": F.col("v")}, ["g"]).collect()}
    want, seen = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(g, (0, 0))
        want[g, at] = (n + 1, s)
        seen[g] = (n + 1, s + v)
    assert got == want


def test_a_long_list_is_numbered_in_many_tasks(spark):
    n = 200_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ground = spark.range(n).select((n - F.col("id")).alias("position"), F.lit("general").alias("category"), F.col("id").alias("q"))
    few = spark.createDataFrame([(2, "b"), (1, "a")], "position long, q string")
    rows = sm.question_set(ground.withColumn("q", F.col("q").cast("string")), few, few)
    part = rows.where("expected_behavior = 'answer' AND category = 'general'")
    assert part.where(F.col("question_id") != F.format_string("general-%04d", n - 1 - F.col("q").cast("long"))).isEmpty()
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["question_id"] for r in rows.where("category = 'refusal'").orderBy("q").collect()] == ["refusal-0000", "refusal-0001"]


def test_ordered_files(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("doc_id"), (F.col("id") % 3).cast("int").alias("chunk_index")).repartition(7)
    st.write_ordered(df, path, ["doc_id", "chunk_index"])
    rows = []
    for f in sorted((tmp_path / "o").glob("part-*")):
        rows += [(r["doc_id"], r["chunk_index"]) for r in spark.read.parquet(str(f)).collect()]
    assert rows == sorted(rows) and len(rows) == 5000


TEXTS = ["the cat sat on the mat", "", None, "aaaaaaaaaaaaaaaaaaaa", "naïve 漢字 text 😀 end", "x", "the mat the cat", "line\nline two", "the cat sat on the mat, twice"]
PASSAGES = ["the cat", "t", "at", "aaaaaaaaaa", "漢字 text 😀", "sat on the mat", "absent words of text", "", None, "naïve 漢字 text 😀 end", "line\nline", "he", "aaaaaaaaaaaaaaaaaaaaa", "the cat"]


@pytest.mark.parametrize("rows,chars", [(50_000, 1 << 20), (3, 10)])
def test_substrings_against_brute_force(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(pa_, "MAX_ROWS", rows)
    monkeypatch.setattr(pa_, "CHARS", chars)
    windows = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, chunk_id string, text string")
    asked = spark.createDataFrame(list(enumerate(PASSAGES)), "query_id int, text string")
    got = sorted((r["query_id"], r["doc_id"], r["chunk_id"]) for r in pa_.holding(windows, asked).collect())
    want = sorted((q, i, f"c{i}") for q, p in enumerate(PASSAGES) if p for i, t in enumerate(TEXTS) if t and p in t)
    assert got == want
    assert pa_.holding(windows.limit(0), asked).isEmpty() and pa_.holding(windows, asked.limit(0)).isEmpty()


def test_anchors_are_rare(spark):
    """A passage of two common letters and one of rare words: the long one is compared in few windows."""
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(400)]
    texts[17] = "word1 word2 peculiar phrase word3"
    windows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word2 peculiar phrase"), (2, "d1")], "query_id long, text string")
    got = sorted((r["query_id"], r["doc_id"]) for r in pa_.holding(windows, asked, ("doc_id",)).collect())
    assert got == sorted([(1, 17)] + [(2, i) for i, t in enumerate(texts) if "d1" in t])
    pieces = pa_.Pieces(["word2 peculiar phrase"])
    n = np.bincount(np.concatenate([p for _, p in pa_.hits(texts, pieces.by_size, pieces.first)]), minlength=pieces.total)
    assert n[pieces.of("word2 peculiar phrase")].min() == 1
