"""Publishing the corpus in tiers by licence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import content_sha256
from provena.operators.chunking import chunk_documents

# Licences of organizations published in full, and those published without text.
FULL_TEXT_LICENSES = {"ooni": "CC BY-NC-SA 4.0", "cipesa": "CC BY 4.0"}
STRIPPED_ORGS = ("freedomhouse", "accessnow")


class UnknownTierError(ValueError):
    """A document belongs to no known organization."""


def release_chunks(docs: DataFrame) -> DataFrame:
    """Chunks with the organization read off the id prefix and the hash of the whole document.

    The hash is taken in the row that is cut, so no join is needed. ``docs`` has doc_id, text, source_url.
    """
    d = docs.withColumn("content_sha256", content_sha256("text")).withColumn("org", org_of("doc_id"))
    return chunk_documents(d, keep=["org", "source_url", "content_sha256"])


def org_of(doc_id: str) -> Column:
    return F.split_part(F.col(doc_id), F.lit("-"), F.lit(1))


def require_known_orgs(chunks: DataFrame, licenses: Mapping[str, str], stripped: Sequence[str]) -> None:
    bad = chunks.where(~F.col("org").isin(*licenses, *stripped)).select("doc_id", "org").take(1)
    if bad:
        raise UnknownTierError(f"{bad[0]['doc_id']}: organization {bad[0]['org']!r} is in no release tier")


def tiers(
    chunks: DataFrame, licenses: Mapping[str, str] = FULL_TEXT_LICENSES, stripped: Sequence[str] = STRIPPED_ORGS
) -> DataFrame:
    """Rows to publish: text and licence in the full tier; ids, offsets and hash in the other.

    An organization of no tier fails the run when its row is reached; ``require_known_orgs`` checks beforehand.
    """
    full = F.col("org").isin(*licenses)
    lic = F
    for org, name in licenses.items():
        lic = lic.when(F.col("org") == org, F.lit(name))
    tier = (
        F.when(full, "full-text")
        .when(F.col("org").isin(*stripped), "metadata-only")
        .otherwise(F.raise_error(F.concat(F.lit("no release tier for "), "org")))
    )
    return chunks.select(
        tier.alias("tier"),
        "org",
        "doc_id",
        "chunk_id",
        "char_start",
        "char_end",
        F.when(full, F.col("text")).alias("text"),
        lic.alias("license"),
        F.when(~full, F.col("source_url")).alias("source_url"),
        F.when(~full, F.col("content_sha256")).alias("content_sha256"),
    )


def write_release(rows: DataFrame, path: str) -> None:
    """One folder per tier and organization; a large organization is still many files."""
    rows.write.mode("overwrite").partitionBy("tier", "org").parquet(path)


def counts(rows: DataFrame) -> DataFrame:
    """Documents and chunks per tier. Documents are counted first, so no tier is gathered in one task."""
    per_doc = rows.groupBy("tier", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("tier").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_n").alias("n_chunks"))


def unpack(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the full-text tier, and for each document the row its metadata comes from (smallest chunk id)."""
    full = rows.where(F.col("tier") == "full-text")
    meta = full.groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_id"))
    return full, meta
