"""Per-document metadata records and the lifecycle of documents and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import collapse_spaces
from provena.session import cut_lineage

SCHEMA_VERSION = "1.1"  # fixed value
# Included documents whose ids are broadcast: eight bytes each.
MAX_INCLUDED = 2_000_000
DECLARED = (
    "title", "organization", "countries", "publication_date", "url", "doc_type",
    "source_format", "topics", "language",
)


class MissingInputError(RuntimeError):
    """An included document lacks a declaration or a passing validation result."""


def declared_block() -> Column:
    return F.struct(
        *DECLARED, collapse_spaces("selection_rationale").alias("selection_rationale"), F.col("corpus_version")
    )


def extraction_method(source_format: str = "source_format") -> Column:
    c = F.col(source_format)
    return F.when(c == "pdf", "pdf-text").when(c == "json", "json-field-extraction").otherwise("html-main-text")


def derived_block() -> Column:
    """Facts about the text, taken from the validation result and not computed again."""
    return F.struct(
        F.col("sha256"),
        F.col("file_size_bytes").cast("bigint").alias("file_size_bytes"),
        F.col("tier2.word_count").alias("extracted_word_count"),
        extraction_method().alias("extraction_method"),
        F.col("extraction_date"),
        F.col("tier2.language").alias("detected_language"),
        F.coalesce("tier2.language_confidence", F.lit(0.0)).alias("detected_language_confidence"),
        F.when(F.size("tier2_flags") > 0, "valid_with_warnings").otherwise("valid").alias("validation_status"),
        F.col("tier2_flags").alias("validation_warnings"),
    )


def lifecycle_block() -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit("active").alias("status"),
        none.alias("superseded_by"),
        none.alias("supersedes"),
        none.alias("reason"),
        none.alias("effective_date"),
    )


def included_only(docs: DataFrame, included: DataFrame) -> DataFrame:
    """The documents that are included, told before anything is done with their texts: the ids travel while they are few enough.

    Beyond ``MAX_INCLUDED`` all documents are returned, and a later join on the narrow results leaves out the others.
    """
    ids = included.select("doc_id").distinct()
    few = ids.limit(MAX_INCLUDED + 1).count() <= MAX_INCLUDED
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if few else docs


def metadata_records(included: DataFrame, decl: DataFrame, validation: DataFrame) -> DataFrame:
    """Records of documents that are included, declared and validated; see ``missing_inputs`` for the gate."""
    ok = validation.where("tier1_passed").select("doc_id", "tier2", "tier2_flags")
    return (
        included.select("doc_id")
        .distinct()
        .join(decl, "doc_id")
        .join(ok, "doc_id")
        .select(
            "doc_id",
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            declared_block().alias("declared"),
            derived_block().alias("derived"),
            lifecycle_block().alias("lifecycle"),
        )
    )


def missing_inputs(included: DataFrame, decl: DataFrame, validation: DataFrame) -> DataFrame:
    """(doc_id, problem) of included documents that cannot get a record."""
    inc = included.select("doc_id").distinct()
    facts = validation.select("doc_id", "tier1_passed")
    return (
        inc.join(decl.select("doc_id", F.lit(True).alias("_d")), "doc_id", "left")
        .join(facts, "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("_d").isNull(), "not declared")
            .when(F.col("tier1_passed").isNull(), "not validated")
            .when(~F.col("tier1_passed"), "tier 1 failed")
            .alias("problem"),
        )
        .where("problem is not null")
    )


def require_inputs(included: DataFrame, decl: DataFrame, validation: DataFrame) -> None:
    bad = missing_inputs(included, decl, validation).take(1)
    if bad:
        raise MissingInputError(f"{bad[0]['doc_id']}: {bad[0]['problem']}")


# --- versions ---------------------------------------------------------------------------------------------


def version_token(v: Column) -> Column:
    """First word of a version line such as ``v1.0 2026-07-13``."""
    return F.split_part(F.trim(v), F.lit(" "), F.lit(1))


def stale(df: DataFrame, current: str, column: str = "corpus_version") -> DataFrame:
    """Rows stamped with another version than the current one, or with none."""
    return df.where(~F.col(column).eqNullSafe(F.lit(current.split()[0])))


def fresh(df: DataFrame, current: str, column: str = "corpus_version") -> DataFrame:
    return df.where(F.col(column) == F.lit(current.split()[0]))


class StaleChunksError(RuntimeError):
    """Chunks of another corpus version would enter the index."""


def require_fresh(df: DataFrame, current: str, column: str = "corpus_version") -> DataFrame:
    """Fail the run on stale chunks: the policy of index building (sampling skips them, search refuses)."""
    if not stale(df, current, column).isEmpty():
        raise StaleChunksError(f"chunks of another version than {current!r}: chunk again first")
    return df


def version_drift(records: DataFrame) -> DataFrame:
    """Documents whose chunking stamp differs from their declared version."""
    return records.where(~F.col("chunked_version").eqNullSafe(F.col("declared_version")))


# --- supersession -----------------------------------------------------------------------------------------


def resolve_supersession(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(doc_id, current_doc, depth) for every superseded document.

    ``links`` has doc_id, superseded_by. Pointers are doubled each round, so a chain of n documents takes
    log2(n) rounds over the superseded documents alone. Lineage is cut between rounds. A chain that never ends
    is an error.
    """
    cur = links.select("doc_id", F.col("superseded_by").alias("current_doc"), F.lit(1).cast("bigint").alias("depth"))
    for _ in range(max_rounds):
        nxt = cur.select(
            F.col("doc_id").alias("_id"), F.col("current_doc").alias("_next"), F.col("depth").alias("_hops")
        )
        stepped = cut_lineage(
            cur.join(nxt, F.col("current_doc") == F.col("_id"), "left").select(
                "doc_id",
                F.coalesce("_next", "current_doc").alias("current_doc"),
                (F.col("depth") + F.coalesce("_hops", F.lit(0))).alias("depth"),
                F.col("_id").isNotNull().alias("_moved"),
            )
        )
        cur = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return cur
    raise ValueError("supersession pointers form a cycle")
