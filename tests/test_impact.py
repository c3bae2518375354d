"""Impact-ordered postings: the layout, the bounds, how many blocks are opened, skewed terms and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import impact as im
from provena.operators import index as ix
from provena.operators import search as se
from provena.operators.chunking import chunk_documents
from provena.plans import common as c

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return se.index_documents(c.documents(spark, SF)).build()


def all_scores(index, qterms):
    """Every pair that shares a term, by a plain join over the forward rows."""
    rows = index.rows.select("chunk_id", "norm", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    hit = rows.select("chunk_id", "norm", F.col("t.terms").alias("term"), F.col("t.weights").alias("x")).join(qterms, "term")
    return hit.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("x") / (F.col("norm") * F.col("qnorm"))), 9).alias("score"))


def test_layout(corpus):
    """Postings of a block lie by term and fall in weight, places point at chunks, and nothing is lost."""
    rows = corpus.inverted.collect()
    for r in rows:
        keys = [(t.encode(), -w) for t, w in zip(r["terms"], r["weights"])]
        assert keys == sorted(keys) and set(r["places"]) <= set(range(len(r["ids"]))) and r["ids"] == sorted(r["ids"])
    assert sum(len(r["terms"]) for r in rows) == corpus.rows.agg(F.sum(F.size("terms"))).first()[0]


def test_results_are_exact_and_most_blocks_stay_closed(spark, corpus):
    q = c.queries(spark, SF)
    terms = ix.query_terms(q, corpus.stats)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in im.search(corpus.inverted, terms, 10).collect()}
    want = se.top_k(all_scores(corpus, terms).where("score > 0"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 10)
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in want.collect()}
    assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
    assert all(abs(got[key][1] - v[1]) < 2e-9 for key, v in want.items())
    # one task over all blocks
    scan = im.Scan(terms.select("query_id", "term", "w", "qnorm").toArrow(), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    for batch in corpus.inverted.toArrow().to_batches(max_chunksize=40):
        scan.add(batch)
    assert 2 * scan.opened < scan.possible and len(scan.best.rows()[0]) == len(want)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_skewed_terms_ties_and_short_lists(spark, k):
    """One term in every chunk, copies that tie, queries of the common term alone, of unknown terms, and with fewer hits than k."""
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, "common " * int(rng.integers(1, 9)) + " ".join(rng.choice(words, 5))) for i in range(150)]
    docs += [(1000 + i, "common copy same") for i in range(90)]
    index = se.index_documents(spark.createDataFrame(docs, "doc_id long, text string")).build()
    queries = [(1, "common"), (2, "copy same common"), (3, "nowhere known"), (4, "w1 w2 w3 w4 common"), (5, "w7"), (6, "")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    terms = ix.query_terms(q, index.stats)
    gone = spark.createDataFrame([(i,) for i in range(1000, 1050)], "doc_id long")
    for excluded in (None, gone):
        got = se.text_leg(index, [terms], k, excluded)
        full = all_scores(index, terms).where("score > 0")
        if excluded is not None:
            full = se.with_doc_id(full).join(excluded.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti")
        want = se.top_k(full, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
        assert rows(got) == rows(want)


def test_a_long_document_is_many_blocks(spark):
    docs = spark.createDataFrame([(1, "word " * 40_000), (2, "word other")], "doc_id long, text string")
    index = se.index_documents(docs).build()
    assert index.inverted.count() >= 20 and index.inverted.agg(F.max(F.size("ids"))).first()[0] <= 6 * im.BLOCK_CHUNKS


def test_no_posting_is_shuffled_and_both_ways_agree(spark, monkeypatch):
    """Chunks are weighed where they are read; where the counts are too many to travel, the shuffled postings give the same rows."""
    docs = c.table(spark, SF, "documents").where("doc_id < 300")
    index = se.index_documents(docs).build()
    known = ix.term_dictionary(index.stats)
    assert "Exchange" not in ix.weighed_rows(chunk_documents(docs), known, 1)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ix, "MAX_TERMS", 10)
    assert ix.term_dictionary(index.stats) is None
    plain = se.index_documents(docs).build()

    def rows(i):
        out = {}
        for r in i.rows.collect():
            out[r["chunk_id"]] = (sorted((t, round(w, 9)) for t, w in zip(r["terms"], r["weights"])), round(r["norm"], 9), [round(v, 6) + 0.0 for v in r["vec"]])
        return out

    assert rows(index) == rows(plain) != {}


def test_an_empty_index_and_no_queries(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    index = se.index_documents(docs).build()
    q = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert se.search(index, q, method="text").isEmpty()
    full = se.index_documents(spark.createDataFrame([(1, "word")], "doc_id long, text string")).build()
    assert se.search(full, q.limit(0), method="text").isEmpty()
