"""Records of included documents: texts of others are not looked at, near-duplicates are looked for among all."""

import pytest
from pyspark.sql import functions as F

from provena.operators import metadata as md
from provena.operators import quality as ql
from provena.plans import common as c
from provena.plans import corpus as cp


def test_texts_of_others_are_left_out_first(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the text of number {i}") for i in range(9)], "doc_id long, text string").repartition(2)
    included = spark.createDataFrame([(3,), (3,), (7,), (70,)], "doc_id long")
    out = md.included_only(docs, included)
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 7] and out.columns == docs.columns
    out = out.select("doc_id", ql.detect_language("text").alias("language"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("regexp_extract_all") < plan.index("LeftSemi")  # the tree is printed from the top
    monkeypatch.setattr(md, "MAX_INCLUDED", 2)
    assert md.included_only(docs, included).count() == 9


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_records_are_those_of_a_full_validation(spark, monkeypatch, most):
    sf = "/root/testdata/sf0.001"
    included = c.table(spark, sf, "labels").where("quality = 1")
    decl = cp.declared(spark, sf).withColumn("extraction_date", F.lit("2026-01-01"))
    full = {r["doc_id"]: r for r in md.metadata_records(included, decl, cp.validation(spark, sf)).collect()}
    monkeypatch.setattr(md, "MAX_INCLUDED", most)
    got = cp.validation(spark, sf, included)
    some = cp.declared(spark, sf, included=included).withColumn("extraction_date", F.lit("2026-01-01"))
    records = {r["doc_id"]: r for r in md.metadata_records(included, some, got).collect()}
    assert records == full and full
    assert got.count() == (spark.read.parquet(f"{sf}/documents.parquet").join(included, "doc_id", "left_semi").count() if most else c.documents(spark, sf).count())
