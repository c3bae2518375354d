"""The stateful stream across restarts: the cap, its timer, late rows; the deduplicated log across a restart."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from provena.operators.chunking import chunk_documents
from provena.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_the_cap_across_restarts(spark, tmp_path):
    """25 queries in three runs of one checkpoint: numbers go on, a gap starts anew, a timer clears state, late rows are dropped."""
    own = jobs.stateful_session(spark)
    folder, schema = str(tmp_path / "in"), "id long, user_id long, ts timestamp"

    def run():
        stream = jobs.read_files(own, folder, spark.createDataFrame([], schema).schema)
        jobs.write_files(jobs.capped_queries(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(got) == len({r["id"] for r in got})
        return {r["id"]: (r["n_in_session"], r["over_cap"]) for r in got}

    put(spark, folder, [(i, 1, T0 + i * MIN) for i in range(1, 16)] + [(100, 2, T0)], schema)
    assert run() == {**{i: (i, False) for i in range(1, 16)}, 100: (1, False)}
    # the twentieth is the last below the cap; user 2 comes back after the gap
    put(spark, folder, [(i, 1, T0 + i * MIN) for i in range(16, 24)] + [(101, 2, T0 + 45 * MIN), (102, 2, T0 + 46 * MIN)], schema)
    got = run()
    assert [got[i] for i in (20, 21, 23)] == [(20, False), (21, True), (23, True)] and (got[101], got[102]) == ((1, False), (2, False))
    # a day later: every session has ended, its timer has fired
    put(spark, folder, [(200, 3, T0 + 24 * 60 * MIN)], schema)
    run()
    put(spark, folder, [(24, 1, T0 + 24 * MIN), (201, 1, T0 + 24 * 60 * MIN)], schema)
    got = run()
    assert 24 not in got and got[201] == (1, False)


def test_the_log_is_deduplicated_across_a_restart(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "id long, ts timestamp"

    def run():
        stream = jobs.read_files(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.write_files(jobs.dedup_log(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(spark, folder, [(1, T0), (2, T0), (1, T0)], schema)
    assert run() == [1, 2]
    put(spark, folder, [(1, T0), (3, T0 + 10 * MIN)], schema)
    assert run() == [1, 2, 3]
    put(spark, folder, [(4, T0 + 72 * 60 * MIN)], schema)
    assert run() == [1, 2, 3, 4]
    put(spark, folder, [(5, T0), (6, T0 + 72 * 60 * MIN)], schema)  # 5 is older than the watermark
    assert run() == [1, 2, 3, 4, 6]


def test_daily_feedback_drops_late_votes(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "id long, ts timestamp, feedback int"

    def run():
        stream = jobs.read_files(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.write_files(jobs.daily_feedback(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return {r["time"]: (r["up"], r["down"]) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("time") < F.lit(T0 + 60 * 24 * MIN)).collect()}

    put(spark, folder, [(1, T0, 1), (2, T0 + MIN, -1), (3, T0 + 4 * 24 * 60 * MIN, 1)], schema)
    assert run() == {T0: (1, 1)}
    put(spark, folder, [(4, T0 + 2 * MIN, 1)], schema)
    assert run() == {T0: (1, 1)}


@pytest.mark.parametrize("parts", [0, 3])
def test_tables_in_many_files_are_streamed_whole(spark, tmp_path, parts):
    """A table is one file or a folder of files; registered streams read all of it."""
    from provena.plans import streams

    docs = [(i, f"text of {i} " * 200, "en", f"src{i % 3}", len(f"text of {i} " * 200)) for i in range(12)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    events = spark.createDataFrame([(i, dt.datetime(2026, 1, 1 + i % 9)) for i in range(20)], "event_id long, ts timestamp_ntz")
    for name, df in (("documents", docs), ("events", events)):
        path = tmp_path / f"{name}.parquet"
        df.repartition(max(parts, 1)).write.parquet(str(path if parts else tmp_path / name))
        if not parts:
            shutil.copy(next((tmp_path / name).glob("*.parquet")), path)
    sf = str(tmp_path)
    want = chunk_documents(docs).join(docs.where("n_chars % 13 <> 0").select("doc_id"), "doc_id").select("chunk_id")
    got = streams.stream_ingest_chunks(spark, sf).select("chunk_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()) != []
    assert streams.drain(spark, streams.event_stream(spark, sf)).count() == 20
