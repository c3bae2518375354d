"""Readers and writers of the tables the jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena import schemas
from provena.sources.snapshots import SnapshotTable


def chunk_table(spark: SparkSession, path: str, schema: str | T.StructType = schemas.CHUNK, buckets: int = 1024) -> SnapshotTable:
    """Chunk table in hash buckets of the document id: one folder per document would be millions of folders.

    ``replace`` puts all chunks of a document in place of its old ones; readers never see half a change.
    """
    return SnapshotTable(spark, path, schema, "doc_id", buckets)


def fingerprint_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """Recorded fingerprints (org, doc_id, field, value), replaced by document."""
    return SnapshotTable(spark, path, schemas.CHECKSUM_FIELD, "doc_id", buckets)


def metadata_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """Metadata records, replaced by document; a block that a record lacks stays null."""
    return SnapshotTable(spark, path, schemas.METADATA, "doc_id", buckets)


def page_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """Page breakpoints by document: null where a format has no pages, empty where a document has none."""
    return SnapshotTable(spark, path, schemas.PAGE_BREAKPOINTS, "doc_id", buckets)


def validation_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """Validation results, replaced by document; tier 2 is null for documents that failed tier 1."""
    return SnapshotTable(spark, path, schemas.VALIDATION, "doc_id", buckets)


def write_ordered(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A folder whose files, taken by name, hold the rows in the order of ``by``: each task sorts one range of it."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records kept as one JSON file each, or as JSON lines."""
    return spark.read.schema(schemas.CHUNK).option("multiLine", True).json(path)


def index_rows(chunks: DataFrame) -> DataFrame:
    """The flat columns search needs from nested chunk records."""
    meta = "document_metadata"
    return chunks.select(
        "chunk_id",
        "doc_id",
        "text",
        "pages",
        F.col(f"{meta}.declared.organization").alias("organization"),
        F.coalesce(f"{meta}.declared.countries", F.array().cast("array<string>")).alias("countries"),
        F.col(f"{meta}.declared.publication_date").alias("publication_date"),
        F.col(f"{meta}.lifecycle.status").alias("lifecycle_status"),
        F.col(f"{meta}.chunking.corpus_version").alias("corpus_version"),
    )


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON-lines log; blank lines are no records."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).na.drop(how="all")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def included_documents(log: DataFrame) -> DataFrame:
    """Documents a decision log marks as included: lines ``## <id> — Included`` of a text column ``value``."""
    return (
        log.select(F.regexp_extract("value", r"^## (\S+) — Included\s*$", 1).alias("doc_id"))
        .where("doc_id <> ''")
        .distinct()
    )


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return included_documents(spark.read.text(path))


def decision_events(df: DataFrame, kind: str, reason: Column, at: str) -> DataFrame:
    """Rows for the append-only decision log: exclusion, acquisition-failure or content-drift."""
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(kind).alias("kind"), reason.alias("reason"), F.lit(at).alias("at"))


def append_decisions(events: DataFrame, path: str) -> None:
    schemas.conform(events, schemas.DECISION).write.mode("append").parquet(path)


def pending_extractions(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows without text yet; a PDF also needs its page table."""
    ok = done.where((F.length("text") > 0) & (~F.col("is_pdf") | F.col("has_pages"))).select("doc_id")
    return manifest.join(ok, "doc_id", "left_anti")


def extraction_outcome(text: Column, supported: Column) -> Column:
    """An empty result is a failure and is never written."""
    return F.when(~supported, "unsupported").when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").otherwise("ok")


def append_interactions(rows: DataFrame, path: str) -> None:
    schemas.conform(rows, schemas.INTERACTION).write.mode("append").parquet(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions under the full schema: columns added later are null in older files."""
    return schemas.conform(spark.read.option("mergeSchema", True).parquet(path), schemas.INTERACTION)


def write_review_sheets(sample: DataFrame, slim_path: str, full_path: str) -> None:
    """Sheets for human reviewers: one without and one with the excerpts; the verdict is left blank."""
    blank = F.lit("").alias("human_verdict")
    slim = sample.select("judgment_id", "question_id", "category", "verdict", "reason", blank)
    full = sample.select(
        "judgment_id", "question_id", "category", "claim_text",
        F.to_json("cited_chunk_texts").alias("cited_chunk_texts"), "verdict", "reason", blank,
    )
    for df, path in ((slim, slim_path), (full, full_path)):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    ddl = "judgment_id string, question_id string, category string, verdict string, reason string, human_verdict string"
    return spark.read.schema(ddl).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def choose_question_set(questions: DataFrame, prefer: tuple[str, ...] = ("filtered", "raw")) -> DataFrame:
    """The first set of ``questions`` (column ``set``) that has rows; none at all is an error."""
    for name in prefer:
        part = questions.where(F.col("set") == name)
        if not part.isEmpty():
            return part
    raise ValueError(f"no question set among {prefer}")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
