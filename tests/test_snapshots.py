"""Tables of versions: readers during writes, failed writes, two writers, old versions; streams that write to them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from provena.operators.chunking import chunk_documents
from provena.sources import stores as st
from provena.sources.snapshots import ConflictError, SnapshotTable
from provena.streaming import jobs

SCHEMA = "doc_id long, v string"


def rows(df):
    return sorted((r["doc_id"], r["v"]) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, buckets=5)
    t.overwrite(spark.createDataFrame([(i, "old") for i in range(30)] + [(7, "second")], SCHEMA))
    return t


def test_replace_add_and_remove(spark, table):
    assert table.replace(spark.createDataFrame([(7, "new"), (99, "added")], SCHEMA)) == 2
    assert rows(table.read()) == sorted([(i, "old") for i in range(30) if i != 7] + [(7, "new"), (99, "added")])
    table.replace(spark.createDataFrame([], SCHEMA), keys=spark.createDataFrame([(i,) for i in range(29)], "doc_id long"))
    assert rows(table.read()) == [(29, "old"), (99, "added")]
    table.overwrite(spark.createDataFrame([], SCHEMA))
    assert table.read().isEmpty() and table.versions() == [1, 2, 3, 4]


def test_a_reader_keeps_its_version(spark, table):
    before = table.read()
    table.replace(spark.createDataFrame([(i, "new") for i in range(30)], SCHEMA))
    assert {v for _, v in rows(before)} == {"old", "second"} and len(rows(before)) == 31
    assert rows(table.read()) == [(i, "new") for i in range(30)]
    assert rows(table.read(1)) == rows(before)
    with pytest.raises(ValueError):
        table.read(9)


def test_only_touched_buckets_are_written(spark, table):
    folders = table.snapshot()["folders"]
    table.replace(spark.createDataFrame([(7, "new")], SCHEMA))
    now = table.snapshot()["folders"]
    assert sum(folders[b] != now[b] for b in folders) == 1


def test_a_failed_write_changes_nothing(spark, table):
    before = rows(table.read())
    broken = spark.createDataFrame([(1, "x"), (2, "y")], SCHEMA).withColumn("v", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        table.replace(broken)
    assert table.versions() == [1] and rows(table.read()) == before
    # a job that died before it could name its version leaves a folder that nobody reads
    spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(f"{table.path}/data/orphan/bucket=0")
    assert rows(table.read()) == before and table.expire(1) == ["orphan"]
    assert rows(table.read()) == before


def test_of_two_writers_both_come_through(spark, table, monkeypatch):
    """Another writer commits while this one is at work: the change is made again on top of it."""
    real, raced = table._claim, []

    def claim(version, text):
        if not raced:
            raced.append(version)
            other = SnapshotTable(spark, table.path, SCHEMA, buckets=5)
            other.replace(spark.createDataFrame([(1, "theirs"), (2, "theirs")], SCHEMA))
        return real(version, text)

    monkeypatch.setattr(table, "_claim", claim)
    assert table.replace(spark.createDataFrame([(1, "mine")], SCHEMA)) == 3
    got = dict(r for r in rows(table.read()) if r[0] in (1, 2))
    assert got == {1: "mine", 2: "theirs"}
    monkeypatch.setattr(table, "_claim", lambda *_: False)
    with pytest.raises(ConflictError):
        table.replace(spark.createDataFrame([(1, "mine")], SCHEMA))


def test_a_batch_counts_once(spark, table):
    new = spark.createDataFrame([(1, "batch")], SCHEMA)
    assert table.replace(new, writer="w", batch=4) == 2
    assert table.replace(spark.createDataFrame([(1, "again")], SCHEMA), writer="w", batch=4) == 2
    assert table.replace(spark.createDataFrame([(1, "other")], SCHEMA), writer="x", batch=0) == 3
    assert [v for k, v in rows(table.read()) if k == 1] == ["other"]


def test_old_versions_expire(spark, table):
    for i in range(3):
        table.replace(spark.createDataFrame([(1, f"v{i}")], SCHEMA))
    before = rows(table.read())
    table.expire(2)
    assert table.versions() == [3, 4] and rows(table.read()) == before and len(rows(table.read(3))) == 31


def test_records_keep_null_apart_from_empty(spark, tmp_path):
    pages = st.page_table(spark, str(tmp_path / "p"))
    pages.overwrite(spark.createDataFrame([("a", None), ("b", []), ("c", [(1, 0, 5)])], "doc_id string, pages array<struct<page:int,char_start:int,char_end:int>>"))
    assert {r["doc_id"]: r["pages"] and [tuple(p) for p in r["pages"]] for r in pages.read().collect()} == {"a": None, "b": [], "c": [(1, 0, 5)]}
    meta = st.metadata_table(spark, str(tmp_path / "m"))
    meta.overwrite(spark.createDataFrame([("a", "1.0")], "doc_id string, schema_version string"))
    got = meta.read().first()
    assert got["schema_version"] == "1.0" and got["lifecycle"] is None and got["chunking"] is None
    val = st.validation_table(spark, str(tmp_path / "v"))
    val.overwrite(spark.createDataFrame([("a", False, "empty", None), ("b", True, None, [])], "doc_id string, tier1_passed boolean, tier1_reason string, tier2_flags array<string>"))
    assert {r["doc_id"]: (r["tier1_passed"], r["tier1_reason"], r["tier2_flags"], r["tier2"]) for r in val.read().collect()} == {"a": (False, "empty", None, None), "b": (True, None, [], None)}
    prints = st.fingerprint_table(spark, str(tmp_path / "f"))
    prints.overwrite(spark.createDataFrame([("o", "a", "sha256", "00")], "org string, doc_id string, field string, value string"))
    prints.replace(spark.createDataFrame([("o", "a", "sha256", "01")], "org string, doc_id string, field string, value string"))
    assert [r["value"] for r in prints.read().collect()] == ["01"]


# ---- streams ---------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, recorded_sha256 string, sent int"
CHUNKS = "chunk_id string, doc_id long, chunk_index int, char_start int, char_end int, text string"


def send(spark, folder, docs):
    df = spark.createDataFrame([(i, t, None, n) for i, t, n in docs], DOCS)
    df.withColumn("recorded_sha256", F.when(F.col("text") == "bad", "stale").otherwise(F.sha2("text", 256))).coalesce(1).write.mode("append").parquet(folder)


def test_documents_sent_again_leave_no_old_chunk(spark, tmp_path):
    """Three batches with a restart between them: longer, shorter, unsound and repeated texts."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    table = SnapshotTable(spark, str(tmp_path / "chunks"), CHUNKS, buckets=4)

    def run():
        stream = jobs.read_files(spark, folder, spark.createDataFrame([], DOCS).schema)
        jobs.upsert_chunks(stream, table, mark, ["sent"]).awaitTermination()

    def expected(docs):
        want = chunk_documents(spark.createDataFrame(docs, "doc_id long, text string"))
        return sorted((r["chunk_id"], r["text"]) for r in want.collect())

    def got():
        return sorted((r["chunk_id"], r["text"]) for r in table.read().collect())

    send(spark, folder, [(1, "a" * 5000, 1), (2, "b" * 2000, 1), (3, "c", 1)])
    run()
    assert got() == expected([(1, "a" * 5000), (2, "b" * 2000), (3, "c")])
    send(spark, folder, [(1, "short", 2), (1, "older" * 900, 1), (3, "bad", 2)])
    run()
    assert got() == expected([(1, "short"), (2, "b" * 2000), (3, "c")])
    version = table.versions()[-1]
    run()  # nothing new
    assert table.versions()[-1] == version
    # the last batch runs again, as after a crash between its commit and its checkpoint
    for f in (tmp_path / "mark" / "commits").iterdir():
        if f.name.lstrip(".").split(".")[0] == "1":
            f.unlink()
    run()
    assert table.versions()[-1] == version and got() == expected([(1, "short"), (2, "b" * 2000), (3, "c")])


def test_votes_meet_their_interactions_and_late_ones_do_not(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    asked, given = str(tmp_path / "i"), str(tmp_path / "v")

    def put(folder, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)

    vote = "id long, value short, at timestamp"
    put(asked, [(1, t0), (2, t0 + day), (3, t0 + 2 * day)], "id long, ts timestamp")
    put(given, [(1, 1, t0 + day), (1, -1, t0 + 2 * day), (2, None, t0 + 2 * day), (3, 1, t0), (9, 1, t0)], vote)

    def run():
        i = jobs.read_files(spark, asked, spark.read.parquet(asked).schema)
        v = jobs.read_files(spark, given, spark.read.parquet(given).schema)
        jobs.write_files(jobs.apply_votes(i, v), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return sorted((r["id"], r["feedback"], r["feedback_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [(1, -1, t0 + 2 * day), (1, 1, t0 + day)]
    assert run() == first
    # in time for number 2; number 1 is too old by now once the clock has moved on
    put(given, [(2, 1, t0 + 3 * day)], vote)
    put(asked, [(4, t0 + 40 * day)], "id long, ts timestamp")
    put(given, [(4, 1, t0 + 41 * day)], vote)
    assert run() == sorted(first + [(2, 1, t0 + 3 * day), (4, 1, t0 + 41 * day)])
    put(given, [(1, 1, t0 + 5 * day)], vote)
    assert run() == sorted(first + [(2, 1, t0 + 3 * day), (4, 1, t0 + 41 * day)])
