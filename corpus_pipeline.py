"""From raw documents to a mix for training: each stage is one of the operators and works on what the one before has kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again for the next one. All
but the last keep the columns of ``docs``, whatever else it holds. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small
from provena.llm import toxicity as tox
from provena.llm.common import free, held_out, table
from provena.llm.decontamination import Decontamination
from provena.llm.line_dedup import LineDedup
from provena.llm.mixing import Mix
from provena.llm.ngram_join import JaccardJoin
from provena.session import discard, written_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the classifier learns from the labelled ones, less every fifth by hash."""
    learn = ~held_out("doc_id", 5, 0)
    model = tox.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    toxic = free(docs, "toxic")
    return model.score(docs, out=toxic).where(F.col(toxic) < 0.5).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; ``n_chars`` follows. A document of which nothing is left goes."""
    name = free(docs, "removed")
    removed = F.col(name)
    out = LineDedup().clean(docs, removed=name).where((removed == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        cut = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(removed > 0, cut).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Documents without an id or words stay."""
    classes = JaccardJoin().classes(docs)
    name = free(docs, "gone")
    gone = written_table(classes.where("key <> component").select(F.col("key").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone, 1_000_000), F.col("doc_id") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = Decontamination().matches(docs.select(row.alias("row"), "text"), table(spark, sf_dir, "benchmark"), key="row")
    name = free(docs, "gone")
    gone = written_table(found.select(F.col("key").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone, 1_000_000), row == F.col(name), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken."""
    return Mix().taken(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# Neither the trained classifier nor the rolling chunk boundaries can be said in SQL: tests hold each stage against a
# brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written_table(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
