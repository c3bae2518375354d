"""Source declarations, the manifest and checksum lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import schemas
from provena.functions.ranking import broadcast_if_small


def read_declarations(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.DECLARATION).format(fmt).load(path)


def resolve_modes(decl: DataFrame, orgs: DataFrame) -> DataFrame:
    """Effective acquisition mode (document, else organization, else auto) and byte stability (else true)."""
    o = orgs.select("org", "default_acquisition", F.col("raw_bytes_stable").alias("_stable"))
    return (
        decl.join(broadcast_if_small(o), "org", "left")
        .withColumn("acquisition", F.coalesce("acquisition", "default_acquisition", F.lit("auto")))
        .withColumn("raw_bytes_stable", F.coalesce("_stable", F.lit(True)))
        .drop("default_acquisition", "_stable")
    )


def tracked_orgs(orgs: DataFrame) -> DataFrame:
    """Organizations whose content hash is tracked: those with unstable bytes."""
    return orgs.where(~F.coalesce("raw_bytes_stable", F.lit(True))).select("org")


def has_real_hash(sha: str | Column = "sha256") -> Column:
    c = F.col(sha) if isinstance(sha, str) else sha
    return (F.coalesce(c, F.lit("")) != "") & ~F.startswith(c, F.lit("REPLACE_ME"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with countries as an array. A missing manifest is an error."""
    m = spark.read.schema(schemas.MANIFEST).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return m.withColumn("countries", F.split("countries", ","))


def manifest_lines(rows: DataFrame) -> DataFrame:
    """Manifest columns in file order; countries joined by commas."""
    return rows.select(
        *[F.concat_ws(",", "countries").alias("countries") if f == "countries" else f for f in (x.name for x in schemas.fields(schemas.MANIFEST))]
    )


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rebuild the manifest from this run's rows."""
    manifest_lines(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def checksum_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("  ", "sha256", "local_path").alias("value"))


def write_checksums(rows: DataFrame, path: str) -> None:
    checksum_lines(rows).write.mode("overwrite").text(path)


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their hash: path, content, file_size_bytes, file_date, file_sha256."""
    return spark.read.format("binaryFile").load(path).select(
        "path",
        "content",
        F.col("length").alias("file_size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd").alias("file_date"),
        F.sha2("content", 256).alias("file_sha256"),
    )


def upsert_checksums(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge (org, doc_id, field, value) rows into a table of them, new values first."""
    keys = ["org", "doc_id", "field"]
    n = new.select(*keys, F.col("value").alias("_new"))
    return old.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", "value").alias("value"))


def checksum_table(rows: DataFrame) -> DataFrame:
    """One row per document from keyed fields: (org, doc_id, sha256, content_sha256)."""
    return rows.groupBy("org", "doc_id").pivot("field", ["sha256", "content_sha256"]).agg(F.max("value"))
