"""Coverage of the corpus by topic, country, year and organization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thin_evidence(docs: DataFrame, dims: tuple[str, ...] = ("topic", "country")) -> DataFrame:
    """Combinations covered by exactly one document or exactly one organization.

    ``docs`` has one row per document with organization, topics[], countries[]. A document counts once per
    combination and organization, then organizations are counted; both steps combine before they shuffle.
    """
    rows = docs.select(
        "organization", F.explode(F.array_distinct("topics")).alias("topic"), "countries"
    ).select("organization", "topic", F.explode(F.array_distinct("countries")).alias("country"))
    per_org = rows.groupBy(*dims, "organization").agg(F.count(F.lit(1)).alias("_docs"))
    out = per_org.groupBy(*dims).agg(
        F.sum("_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_orgs")
    )
    return out.where((F.col("n_docs") == 1) | (F.col("n_orgs") == 1))


def coverage_contribution(docs: DataFrame) -> DataFrame:
    """(doc_id, new_combinations): country/year/organization combinations a document is the first to bring.

    ``docs`` has doc_id, organization, countries[], publication_date. The first document of a combination is its
    smallest id, found by a combined minimum; documents that add nothing have 0.
    """
    year = F.left("publication_date", F.lit(4))
    first = (
        docs.select("doc_id", "organization", year.alias("year"), F.explode(F.array_distinct("countries")).alias("country"))
        .groupBy("organization", "year", "country")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("new_combinations"))
    )
    return docs.select("doc_id").join(first, "doc_id", "left").select(
        "doc_id", F.coalesce("new_combinations", F.lit(0)).alias("new_combinations")
    )


def in_scope(date: str, tags: str, targets: tuple[str, ...], first_year: int = 2022, last_year: int = 2026) -> Column:
    """Published inside the window and tagged with any target."""
    y = F.left(F.col(date), F.lit(4)).cast("int")
    return y.between(first_year, last_year) & F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in targets]))


def tag_coverage(chunks: DataFrame, tags: str = "tags") -> DataFrame:
    """(with_tags, total): how many chunks the boost can act on."""
    return chunks.agg(
        F.count_if(F.size(F.coalesce(F.col(tags), F.array().cast("array<string>"))) > 0).alias("with_tags"),
        F.count(F.lit(1)).alias("total"),
    )
