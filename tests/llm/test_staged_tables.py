"""What the operators stage goes when it has been used: only what the result reads stays."""

import os

import numpy as np
from pyspark.sql import functions as F

from provena import session
from provena.llm.decontamination import Decontamination
from provena.llm.line_dedup import LineDedup
from provena.llm.ngram_join import JaccardJoin


def staged(spark):
    folder = session.shared_folder(spark).removeprefix("file://") + "/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def corpus(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for _ in range(60)]
    texts += [t.rsplit(" ", 2)[0] + " other end" for t in texts[:20]] + texts[:5]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_the_ngram_join_keeps_classes_and_components_only(spark):
    docs, before = corpus(spark), staged(spark)
    one = JaccardJoin().classes(docs)
    assert len(staged(spark) - before) <= 3
    many = JaccardJoin(parts=3, part_rows=500).classes(docs)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.where(F.col("key") != F.col("component")).count() == 25


def test_line_dedup_keeps_its_spans_and_the_decontamination_nothing(spark):
    docs, before = corpus(spark), staged(spark)
    LineDedup().clean(docs).collect()
    assert len(staged(spark) - before) == 1
    before = staged(spark)
    items = docs.limit(3).select(F.col("doc_id").alias("item_id"), "text")
    assert Decontamination().matches(docs, items).count() >= 3
    assert staged(spark) == before
