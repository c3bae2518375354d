"""What to do with each declared document: the acquisition decision as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.quality import PLACEHOLDER


def is_placeholder(sha: str | Column) -> Column:
    c = F.col(sha) if isinstance(sha, str) else sha
    return F.startswith(c, F.lit(PLACEHOLDER))


def resolve_baseline(declared: Column, derived: Column) -> Column:
    """A derived baseline first, else a declared value that is no placeholder, else null."""
    return F.coalesce(
        F.nullif(derived, F.lit("")), F.when((declared != "") & ~is_placeholder(declared), declared)
    )


def migrated_baselines(decl: DataFrame, derived: DataFrame, field: str = "sha256") -> DataFrame:
    """Declared values that become derived ones on first reading: (org, doc_id, field, value)."""
    missing = decl.join(derived.where(F.col("field") == field).select("org", "doc_id"), ["org", "doc_id"], "left_anti")
    return missing.where((F.col(field) != "") & ~is_placeholder(field)).select(
        "org", "doc_id", F.lit(field).alias("field"), F.col(field).alias("value")
    )


def acquisition_states(decl: DataFrame) -> DataFrame:
    """Add ``state``, ``reason`` and ``sha256_recorded`` to declared documents.

    ``decl`` has doc_id, sha256 (declared), acquisition (auto/manual), raw_bytes_stable, derived_sha256,
    file_sha256 (null when no file is there) and format_problem (of the file).

    States: ``failed`` (integrity problem), ``bootstrapped`` (first hash of an unstable source, recorded),
    ``present`` (verified, nothing to do), ``pending`` (to be placed by hand), ``fetch`` and ``refetch``.
    """
    stable = F.col("raw_bytes_stable")
    there = F.col("file_sha256").isNotNull()
    bad = F.col("format_problem").isNotNull()
    manual = F.col("acquisition") == "manual"
    d = decl.withColumn(
        "_base",
        F.when(stable, F.col("sha256")).otherwise(resolve_baseline(F.col("sha256"), F.col("derived_sha256"))),
    )
    none = F.col("_base").isNull()
    same = F.col("file_sha256") == F.col("_base")
    ladder = [
        (stable & is_placeholder("sha256"), "failed", F.lit("placeholder sha256")),
        (none & there & bad, "failed", F.concat(F.lit("cannot bootstrap from existing file: "), F.col("format_problem"))),
        (none & there, "bootstrapped", F.lit("baseline recorded from existing file")),
        (none & manual, "pending", F.lit("manual acquisition, not yet placed")),
        (none, "fetch", F.lit("first fetch, baseline to be recorded")),
        (there & same & bad, "failed", F.concat(F.lit("checksum matches, but: "), F.col("format_problem"))),
        (there & same, "present", F.lit("checksum matches")),
        (there & manual, "failed", F.lit("checksum mismatch (manual acquisition)")),
        (there, "refetch", F.lit("present but checksum mismatch")),
        (manual, "pending", F.lit("manual acquisition, not yet placed")),
        (F.lit(True), "fetch", F.lit("absent")),
    ]
    state, reason = F, F
    for cond, s, r in ladder:
        state = state.when(cond, F.lit(s))
        reason = reason.when(cond, r)
    sha = F.when(
        F.col("state") == "bootstrapped", F.col("file_sha256")
    ).when(F.col("state") == "present", F.col("file_sha256"))
    return d.withColumn("state", state).withColumn("reason", reason).withColumn("sha256_recorded", sha).drop("_base")


def fetched_states(fetched: DataFrame) -> DataFrame:
    """Verdict on bytes that were fetched elsewhere: format first, then the declared hash of stable sources.

    ``fetched`` has doc_id, sha256, raw_bytes_stable, fetched_sha256, format_problem. Stable sources must match;
    unstable ones record the hash they got.
    """
    state = (
        F.when(F.col("format_problem").isNotNull(), "failed")
        .when(F.col("raw_bytes_stable") & (F.col("fetched_sha256") != F.col("sha256")), "failed")
        .otherwise("acquired")
    )
    return fetched.withColumn("state", state)


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n_docs"))


def manifest_rows(states: DataFrame) -> DataFrame:
    """Documents this run holds: the manifest is rebuilt from them in full."""
    return states.where(F.col("state").isin("present", "bootstrapped", "acquired"))
