"""Operators against brute force, and properties that must hold on any data."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provena.operators import dedup as dd
from provena.operators import evaluate as ev
from provena.operators import index as ix
from provena.operators import search as se
from provena.operators.chunking import chunk_documents
from provena.plans import common as c
from provena.plans import registry
from provena.sources import declarations as dc
from provena.sources import stores as st

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    sigs = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            s = b
            for bit in rng.sample(range(64), d):
                s ^= 1 << bit
            sigs.add(s)
    signed = [s - (1 << 64) if s >= 1 << 63 else s for s in sigs]
    df = spark.createDataFrame([(s,) for s in signed], "signature bigint")
    got = {frozenset((r["sig_a"], r["sig_b"])) for r in dd.near_signature_pairs(df).collect()}
    want = {
        frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i]
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    }
    assert got == want and want
    assert dd.near_signature_pairs(df).count() == len(want)


def test_hot_copies_stay_linear(spark):
    docs = spark.createDataFrame([(i, "same text here" if i % 3 else f"other words {i * 7919}") for i in range(300)], "doc_id bigint, text string")
    near = dd.near_duplicates(dd.signatures(docs))
    assert near.count() == 300
    assert near.where("doc_id % 3 <> 0").select("n_copies").distinct().collect()[0][0] == 199


def brute_text(chunks, queries, k):
    tok = lambda t: Counter(re.findall(r"\w{2,}", t.lower()))
    tfs = {cid: tok(t) for cid, t in chunks}
    df = Counter(w for tf in tfs.values() for w in tf)
    n = len(tfs)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
    vec = lambda tf: {w: x * idf[w] for w, x in tf.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    dv = {cid: vec(tf) for cid, tf in tfs.items()}
    out = {}
    for qid, t in queries:
        q = vec(tok(t))
        s = [(-round(sum(x * v.get(w, 0) for w, x in q.items()) / (norm(q) * norm(v)), 9), cid) for cid, v in dv.items() if v and q]
        out[qid] = [cid for sc_, cid in sorted(s) if sc_ < 0][:k]
    return out


@pytest.fixture(scope="module")
def small_index(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, se.index_documents(docs).build()


def test_text_leg_against_brute_force(spark, small_index):
    docs, index = small_index
    q = c.queries(spark, SF)
    (leg,) = se.legs(index, q, 10, None, "text")
    got = {}
    for r in leg.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    ch = [(r["chunk_id"], r["text"]) for r in chunk_documents(docs).select("chunk_id", "text").collect()]
    want = brute_text(ch, [(r["query_id"], r["text"]) for r in q.collect()], 10)
    assert got == {k: v for k, v in want.items() if v}


def test_blocks_of_queries_give_the_same_result(spark, small_index, monkeypatch):
    _, index = small_index
    q = c.queries(spark, SF)
    whole = [sorted(leg.collect()) for leg in se.legs(index, q, 10, None, "hybrid")]
    monkeypatch.setattr(se, "MAX_QUERY_ROWS", 7)
    assert [sorted(leg.collect()) for leg in se.legs(index, q, 10, None, "hybrid")] == whole


def test_search_rules(spark, small_index):
    _, index = small_index
    q = c.queries(spark, SF)
    tags = c.doc_tags(spark, SF)
    on = se.search(index, q, tags=tags, rrf_k=10, keywords=c.ENTITY_KEYWORDS, top=50)
    off = se.search(index, q, tags=tags, rrf_k=10, entity_boost=False, top=50)
    keys = ["query_id", "chunk_id"]
    assert on.select(*keys).exceptAll(off.select(*keys)).isEmpty() and off.select(*keys).exceptAll(on.select(*keys)).isEmpty()
    assert se.search(index, q, method="text").where("score is not null").isEmpty()
    life = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.when(F.col("doc_id") < 100, "retracted").otherwise("active").alias("lifecycle_status"))
    kept = se.search(index, q, lifecycle=life)
    assert kept.where(F.col("doc_id").cast("bigint") < 100).isEmpty()
    assert not se.search(index, q, lifecycle=life, lifecycle_status=None).where(F.col("doc_id").cast("bigint") < 100).isEmpty()


def test_salted_weights_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, "common " + ("rare%d" % i) * (i % 4)) for i in range(50)], "doc_id bigint, text string")
    post = ix.postings(chunk_documents(docs))
    n = F.lit(50)
    stats = ix.term_stats(post, n)
    got = ix.weigh(post, stats, n, salts=4).select("chunk_id", "term", F.round("w", 12).alias("w"))
    want = post.join(stats, "term").select("chunk_id", "term", F.round(F.col("tf") * F.col("idf"), 12).alias("w"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_gold_needs_no_word_inside(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "zz")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "pha beta gamma del"), (2, "zz"), (3, "beta"), (4, "absent words of text")], "query_id bigint, text string")
    got = {(r["query_id"], r["doc_id"]) for r in ev.gold_chunks(chunk_documents(docs), q).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_no_cross_join_in_search(spark, small_index):
    _, index = small_index
    df = se.search(index, c.queries(spark, SF), tags=c.doc_tags(spark, SF), keywords=c.ENTITY_KEYWORDS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_manifest_and_checksums_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d1", "o", 'A "title", with commas', ["KE", "UG"], "2025-01-01", "ab", "p/d1")],
        "doc_id string, org string, title string, countries array<string>, publication_date string, sha256 string, local_path string",
    )
    dc.write_manifest(rows, str(tmp_path / "m"))
    back = dc.read_manifest(spark, str(tmp_path / "m")).first()
    assert back["title"] == 'A "title", with commas' and back["countries"] == ["KE", "UG"]
    dc.write_checksums(rows, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == "ab  p/d1"
    with pytest.raises(Exception):
        dc.read_manifest(spark, str(tmp_path / "missing")).count()


def test_chunk_table_replaces_only_given_documents(spark, tmp_path):
    table = st.chunk_table(spark, str(tmp_path / "chunks"), buckets=4)
    docs = spark.createDataFrame([(str(i), "x" * 2000) for i in range(20)], "doc_id string, text string")
    table.overwrite(chunk_documents(docs))
    table.replace(chunk_documents(spark.createDataFrame([("3", "short")], "doc_id string, text string")))
    n = {r["doc_id"]: r["count"] for r in table.read().groupBy("doc_id").count().collect()}
    assert n["3"] == 1 and sum(n.values()) == 19 * 2 + 1


def test_interactions_schema_is_additive(spark, tmp_path):
    path = str(tmp_path / "log")
    st.append_interactions(spark.createDataFrame([(1, "q")], "id bigint, query string"), path)
    st.append_interactions(spark.createDataFrame([(2, "q", "r")], "id bigint, query string, rewritten_query string"), path)
    rows = {r["id"]: r for r in st.read_interactions(spark, path).collect()}
    assert rows[1]["rewritten_query"] is None and rows[2]["rewritten_query"] == "r" and rows[1]["feedback"] is None


def test_jsonl_skips_blank_lines_and_decision_log_headings(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"judgment_id": "a", "verdict": "partial"}\n\n{"judgment_id": "b"}\n')
    from provena.schemas import JUDGMENT

    assert st.read_jsonl(spark, str(tmp_path / "a.jsonl"), JUDGMENT).count() == 2
    (tmp_path / "log.md").write_text("# Log\n## doc-1 — Included\n## doc-2 — Excluded\n## doc-1 — Included  \n")
    assert [r[0] for r in st.read_decision_log(spark, str(tmp_path / "log.md")).collect()] == ["doc-1"]


def test_checksum_upsert_prefers_new_values(spark):
    ddl = "org string, doc_id string, field string, value string"
    old = spark.createDataFrame([("o", "d", "sha256", "1"), ("o", "e", "sha256", "2")], ddl)
    new = spark.createDataFrame([("o", "d", "sha256", "9"), ("o", "d", "content_sha256", "3")], ddl)
    t = {r["doc_id"]: r for r in dc.checksum_table(dc.upsert_checksums(old, new)).collect()}
    assert (t["d"]["sha256"], t["d"]["content_sha256"], t["e"]["sha256"]) == ("9", "3", "2")


def test_stream_in_small_batches_equals_one_batch(spark, tmp_path):
    from provena.streaming import jobs

    src = str(tmp_path / "in")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("recorded_sha256", F.sha2("text", 256))
    docs.repartition(3).write.parquet(src)
    stream = jobs.read_files(spark, src, docs.schema, files_per_batch=1)
    jobs.write_files(jobs.ingest_chunks(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("chunk_id", "text")
    want = chunk_documents(docs).select("chunk_id", "text")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
