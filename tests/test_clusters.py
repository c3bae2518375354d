"""The partitioned vector index against brute force, and how many vectors it scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import clusters as cl
from provena.operators.clusters import VectorIndex


def brute(vectors, queries, k):
    out = set()
    for qid, q in queries:
        q = np.array(q, float) if q is not None else np.zeros(1)
        if not q.any():
            continue
        s = []
        for i, v in vectors:
            if v is None or not np.isfinite(v).all() or not np.any(v):
                continue
            v = np.array(v, float)
            s.append((-round(float((v / np.sqrt((v * v).sum())) @ (q / np.sqrt((q * q).sum()))), 9), i))
        out |= {(qid, i, -c + 0.0, r) for r, (c, i) in enumerate(sorted(s)[:k], 1)}
    return out


def rows_of(df):
    return {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


def close(got, want):
    """Equal rows; scores may differ by a float's last digit before rounding."""
    assert {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
    have = {(q, i): s for q, i, s, _ in got}
    assert all(abs(have[q, i] - s) < 2e-9 for q, i, s, _ in want)


@pytest.fixture(scope="module")
def clustered():
    """40 directions with near members, one of them holding a third of all vectors as equal copies."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16))
    vectors = [centre[i % 40] + 0.05 * rng.normal(size=16) for i in range(1200)] + [centre[3]] * 600
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(j, [float(x) for x in centre[j] + 0.1 * rng.normal(size=16)]) for j in range(20)]
    return vectors, queries


def test_equal_to_brute_force_and_few_vectors_scored(spark, clustered):
    vectors, queries = clustered
    index = VectorIndex.build(spark.createDataFrame(vectors, "id long, vec array<double>"), "id")
    got = rows_of(index.search(spark.createDataFrame(queries, "query_id long, vec array<double>"), 10))
    close(got, brute(vectors, queries, 10))
    assert index.possible == 1800 * 20 and index.scored < index.possible / 5


def test_a_hot_cluster_is_spread(spark, clustered):
    """Copies of one vector lie in several partitions of the table."""
    vectors, _ = clustered
    index = VectorIndex.build(spark.createDataFrame(vectors, "id long, vec array<double>").repartition(8), "id", write=lambda df: df.cache())
    hot = index.rows.groupBy("cluster").count().orderBy(F.desc("count")).first()["cluster"]
    spread = index.rows.where(F.col("cluster") == hot).select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    assert len(spread) > 1


@pytest.mark.parametrize("k", [1, 7, 50])
def test_odd_vectors(spark, k):
    """Null, zero and non-finite vectors, ties by id, fewer than k vectors, random directions that no bound parts."""
    rng = np.random.default_rng(k)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    vectors += [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [float("inf")] + [1.0] * 7), (104, vectors[5][1]), (105, [2 * x for x in vectors[5][1]])]
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(9)] + [(50, [0.0] * 8), (51, None), (52, vectors[5][1])]
    index = VectorIndex.build(spark.createDataFrame(vectors, "id long, vec array<double>"), "id")
    close(rows_of(index.search(spark.createDataFrame(queries, "query_id long, vec array<double>"), k)), brute(vectors, queries, k))


def test_text_ids_filters_and_blocks(spark, clustered, monkeypatch):
    vectors, queries = clustered
    named = [(f"v{i}", v) for i, v in vectors]
    corpus = spark.createDataFrame(named, "id string, vec array<double>").withColumn("doc", F.substring("id", 2, 9).cast("int") % 3)
    index = VectorIndex.build(corpus, "id", ("doc",))
    q = spark.createDataFrame(queries, "query_id long, vec array<double>")
    allowed = [(i, v) for i, v in named if int(i[1:]) % 3 != 1]
    want = brute(allowed, queries, 25)
    close(rows_of(index.search(q, 25, lambda rows: rows.where("doc <> 1"))), want)
    monkeypatch.setattr(cl, "MAX_QUERY_ROWS", 6)
    monkeypatch.setattr(cl, "SCORES", 500)
    close(rows_of(index.search(q, 25, lambda rows: rows.where("doc <> 1"))), want)


def test_empty(spark, clustered):
    vectors, queries = clustered
    corpus = spark.createDataFrame(vectors, "id long, vec array<double>")
    q = spark.createDataFrame(queries, "query_id long, vec array<double>")
    assert VectorIndex.build(corpus.limit(0), "id").search(q, 5).isEmpty()
    assert VectorIndex.build(corpus, "id").search(q.limit(0), 5).isEmpty()


def test_bounds_hold_for_every_member(spark, clustered):
    vectors, _ = clustered
    index = VectorIndex.build(spark.createDataFrame(vectors, "id long, vec array<double>"), "id", centres=13)
    assert len(index.centres) == 13 and index.size.sum() == 1800
    for r in index.rows.collect():
        v = np.array(r["vec"])
        far = np.arccos(np.clip(v / np.linalg.norm(v) @ index.centres[r["cluster"]], -1, 1))
        assert abs(far - r["angle"]) < 1e-7 and far <= index.radius[r["cluster"]] + 1e-7
