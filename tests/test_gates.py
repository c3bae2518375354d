"""Gates that stop a run, readers and sinks without a query of their own, defaults that are recorded."""

import pytest
from pyspark.sql import functions as F

from provena import schemas
from provena.operators import acquisition as aq
from provena.operators import chunking as ch
from provena.operators import citations as ci
from provena.operators import metadata as md
from provena.operators import quality as ql
from provena.operators import reconcile as rc
from provena.operators import search as se
from provena.sources import declarations as dc
from provena.sources import stores as st


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "doc_id string")


def test_copies_of_corpus_state_must_agree(spark):
    a, b = ids(spark, "1", "2"), ids(spark, "1", "2")
    problems = rc.both_ways("declared-vs-acquired", a, b, "declared but not acquired", "acquired but not declared")
    rc.require_agreement(problems)
    with pytest.raises(rc.DriftError, match="2 disagreement"):
        rc.require_agreement(rc.both_ways("declared-vs-acquired", a, ids(spark, "1", "3"), "declared but not acquired", "acquired but not declared"))


def test_metadata_needs_declared_and_validated_documents(spark):
    decl = ids(spark, "1", "2", "3")
    val = spark.createDataFrame([("1", True), ("2", False)], "doc_id string, tier1_passed boolean")
    md.require_inputs(ids(spark, "1"), decl, val)
    for doc, problem in (("9", "not declared"), ("3", "not validated"), ("2", "tier 1 failed")):
        with pytest.raises(md.MissingInputError, match=problem):
            md.require_inputs(ids(spark, "1", doc), decl, val)


def test_rehydrated_documents_must_be_verified(spark):
    rows = [("1", "text", None, False), ("2", "text", "x", True), ("3", "text", None, True)]
    df = spark.createDataFrame(rows, "doc_id string, text string, baseline string, tracked boolean")
    base = F.when(F.col("doc_id") == "2", ql.content_sha256(F.col("text"))).otherwise(F.col("baseline"))
    st_ = df.select("doc_id", ql.rehydration_status(F.col("text"), base, F.col("tracked")).alias("status"))
    ql.require_verified(st_.where("doc_id <> '3'"))
    with pytest.raises(ql.ContentDriftError, match="first one 3: no_baseline"):
        ql.require_verified(st_)
    ql.require_verified(st_.limit(0))


def test_stale_chunks_do_not_enter_an_index(spark):
    df = spark.createDataFrame([("a", "v1"), ("b", "v1")], "chunk_id string, corpus_version string")
    assert md.require_fresh(df, "v1 2026-01-01").count() == 2
    with pytest.raises(md.StaleChunksError):
        md.require_fresh(df.union(spark.createDataFrame([("c", "v0")], df.schema)), "v1")


def test_the_default_is_recorded_only_after_a_report(spark, tmp_path):
    path = str(tmp_path / "config")
    report = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(ValueError, match="no evaluation report"):
        se.record_default(path, spark, "hybrid", 10, report.limit(0))
    with pytest.raises(ValueError, match="needs rrf_k"):
        se.record_default(path, spark, "hybrid", None, report)

    def k():
        return spark.range(1).select(se.recorded_rrf_k(spark.read.schema(schemas.RRF_CONFIG).parquet(path)).alias("k")).first()["k"]

    se.record_default(path, spark, "hybrid", 30, report)
    assert k() == 30
    se.record_default(path, spark, "text", 30, report)  # no constant for another method: the fallback
    assert k() == se.FALLBACK_RRF_K
    assert spark.read.parquet(path).first()["rrf_k"] is None


def test_chunk_records_and_their_index_columns(spark, tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "a.json").write_text('{"chunk_id": "d-chunk-0000", "doc_id": "d", "text": "t",\n "document_metadata": {"declared": {"organization": "o", "countries": null}, "lifecycle": {"status": "active"}, "chunking": {"corpus_version": "v1"}}}')
    (folder / "b.json").write_text('{"chunk_id": "e-chunk-0000", "doc_id": "e", "text": "u", "pages": [1, 2], "document_metadata": {"declared": {"countries": ["KE"]}}}')
    rows = {r["doc_id"]: r for r in st.index_rows(st.read_chunk_records(spark, str(folder))).collect()}
    assert (rows["d"]["organization"], rows["d"]["countries"], rows["d"]["lifecycle_status"], rows["d"]["corpus_version"]) == ("o", [], "active", "v1")
    assert rows["e"]["countries"] == ["KE"] and rows["e"]["pages"] == [1, 2] and rows["e"]["organization"] is None


def test_review_sheets_and_question_sets(spark, tmp_path):
    sample = spark.createDataFrame([("j1", "q1", "c", "partial", 'a "quoted"\nreason', "claim", ["x", "y"])], "judgment_id string, question_id string, category string, verdict string, reason string, claim_text string, cited_chunk_texts array<string>")
    st.write_review_sheets(sample, str(tmp_path / "slim"), str(tmp_path / "full"))
    slim = st.read_review_sheet(spark, str(tmp_path / "slim")).first()
    assert (slim["judgment_id"], slim["reason"], slim["human_verdict"]) == ("j1", 'a "quoted"\nreason', None)
    full = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "full")).first()
    assert full["cited_chunk_texts"] == '["x","y"]'
    q = spark.createDataFrame([("raw", 1), ("raw", 2), ("filtered", 3)], "set string, n int")
    assert [r["n"] for r in st.choose_question_set(q).collect()] == [3]
    assert st.choose_question_set(q.where("set = 'raw'")).count() == 2
    with pytest.raises(ValueError):
        st.choose_question_set(q.limit(0))


def test_logs_are_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    for v in ("a", "b"):
        st.append_jsonl(spark.createDataFrame([(v,)], "judgment_id string"), path)
    assert st.read_jsonl(spark, path, schemas.JUDGMENT).count() == 2
    path = str(tmp_path / "decisions")
    for v in ("a", "b"):
        st.append_decisions(st.decision_events(ids(spark, v), "exclusion", F.lit("why"), "2026-01-01"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "exclusion", "why", "2026-01-01"), ("b", "exclusion", "why", "2026-01-01")]


def test_extraction_is_pending_until_text_and_pages_are_there(spark):
    m = ids(spark, "1", "2", "3", "4")
    done = spark.createDataFrame([("1", "t", False, False), ("2", "t", True, False), ("3", "", False, False)], "doc_id string, text string, is_pdf boolean, has_pages boolean")
    assert sorted(r["doc_id"] for r in st.pending_extractions(m, done).collect()) == ["2", "3", "4"]


def test_fetched_bytes(spark):
    rows = [("1", "a", True, "a", None), ("2", "a", True, "b", None), ("3", "a", False, "b", None), ("4", "a", True, "a", "bad")]
    df = spark.createDataFrame(rows, "doc_id string, sha256 string, raw_bytes_stable boolean, fetched_sha256 string, format_problem string")
    assert {r["doc_id"]: r["state"] for r in aq.fetched_states(df).collect()} == {"1": "acquired", "2": "failed", "3": "acquired", "4": "failed"}


def test_declarations_and_tracked_organizations(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"org": "o1", "doc_id": "1", "countries": ["KE"]}\n{"org": "o2", "doc_id": "2", "acquisition": "manual"}\n{"org": "o3", "doc_id": "3"}\n')
    decl = dc.read_declarations(spark, str(tmp_path / "d.json"))
    orgs = spark.createDataFrame([("o1", "manual", False), ("o2", "auto", None)], schemas.ORG)
    got = {r["doc_id"]: (r["acquisition"], r["raw_bytes_stable"]) for r in dc.resolve_modes(decl, orgs).collect()}
    assert got == {"1": ("manual", False), "2": ("manual", True), "3": ("auto", True)}
    assert [r["org"] for r in dc.tracked_orgs(orgs).collect()] == ["o1"]


def test_the_chunking_stamp_and_latency(spark):
    r = spark.createDataFrame([("v1", 4)], "version string, n int").select(ch.chunking_block(F.col("version"), "n", "2026-01-01").alias("b")).first()["b"]
    assert (r["chunk_size"], r["chunk_step"], r["total_chunks"], r["chunking_date"], r["corpus_version"]) == (ch.CHUNK_SIZE, ch.CHUNK_STEP, 4, "2026-01-01", "v1")
    df = spark.createDataFrame([(1, 2), (None, 5), (3, None), (None, None)], "retrieval_ms int, llm_ms int")
    assert [r[0] for r in df.select(ci.latency_ms()).collect()] == [3, 5, 3, None]


def test_texts_kept_with_an_answer(spark):
    res = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b")], "query_id int, chunk_id string")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "chunk_id string, text string")
    got = {r["query_id"]: (r["n_retrieved"], r["retrieved_chunks"]) for r in se.with_texts(res, chunks).collect()}
    assert got == {1: (2, {"a": "A", "b": "B"}), 2: (1, {"b": "B"})}
