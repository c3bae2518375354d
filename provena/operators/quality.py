"""Checks on documents: declared format, integrity, language, length, drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import col, content_sha256, found_phrases, match_form, whole_json, word_count

# Phrases of bot-challenge pages, in checking order.
CHALLENGE_PHRASES = (
    "verifying your browser",
    "enable javascript to continue",
    "checking your browser",
    "security checkpoint",
    "just a moment",
)
# Words of a title that are not looked for.
TITLE_STOPWORDS = ("the", "on", "of", "and", "a", "an", "in", "to", "for", "is", "at")
# Topic hints, minimum length, required language, placeholder prefix.
TOPIC_KEYWORDS = (
    "censorship", "internet shutdown", "blocked", "blocking", "network interference",
    "surveillance", "digital rights", "freedom of expression", "vpn", "throttl",
)
MIN_WORD_COUNT = 500
REQUIRED_LANGUAGE = "en"
PLACEHOLDER = "REPLACE_ME"

# Our own profile: the most frequent function words of each language.
LANGUAGE_PROFILE = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "für", "den"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "on", "by", "with", "at"),
    "es": ("el", "los", "las", "que", "y", "es", "por", "para", "con", "una", "del", "se"),
    "fr": ("le", "les", "des", "et", "un", "une", "du", "dans", "qui", "pour", "avec", "sur"),
}


def title_key_words(title: str | Column) -> Column:
    """Words of a title that must be found: longer than two characters and no filler."""
    return F.filter(
        F.split(match_form(title), " "), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOPWORDS)
    )


def missing_title_words(title: str | Column, content: str | Column) -> Column:
    """Title words that occur nowhere in the content, as substrings of its match form."""
    body = F.transform(F.array(match_form(content)), lambda b: F.filter(title_key_words(title), lambda w: ~F.contains(b, w)))
    return F.element_at(body, 1)


def json_incident_text(content: str | Column) -> Column:
    """``incident.text`` of a JSON body, stripped; empty when absent or not JSON."""
    from provena.functions.text import strip

    return strip(F.coalesce(F.get_json_object(col(content), "$.incident.text"), F.lit("")))


def format_problem(content: str | Column, source_format: str | Column, title: str | Column) -> Column:
    """Null when the content looks like its declared format, else why it does not."""
    content, source_format, title = col(content), col(source_format), col(title)
    head = F.substring(content, 1, 5)
    challenge = F.element_at(F.concat(found_phrases(content, CHALLENGE_PHRASES), F.array(F.lit(None).cast("string"))), 1)

    def title_problem(body: Column, where: str, hint: str) -> Column:
        missing = missing_title_words(title, body)
        return F.when(
            F.size(missing) > 0,
            F.concat(
                F.lit("declared title '"), title, F.lit(f"' not found in {where} (missing key word(s): "),
                F.array_join(missing, ", "), F.lit(f"): {hint}"),
            ),
        )

    html = F.when(
        challenge.isNotNull(), F.concat(F.lit("matched known bot-challenge phrase: '"), challenge, F.lit("'"))
    ).otherwise(title_problem(content, "fetched content", "likely a challenge page"))
    body = F.coalesce(F.get_json_object(content, "$.incident.text"), F.lit(""))
    js = (
        F.when(whole_json(content).isNull(), F.lit("not valid JSON"))
        .when(body == "", F.lit("parsed JSON but found no non-empty 'incident.text' field"))
        .otherwise(title_problem(body, "'incident.text'", "likely the wrong record"))
    )
    return (
        F.when(
            source_format == "pdf",
            F.when(head != "%PDF-", F.concat(F.lit("bad PDF magic number (got '"), head, F.lit("', expected '%PDF-')"))),
        )
        .when(source_format == "html", html)
        .when(source_format == "json", js)
    )


def topic_hints(text: str | Column, keywords: Sequence[str] = TOPIC_KEYWORDS) -> Column:
    return found_phrases(text, keywords)


def detect_language(text: str | Column, profile: Mapping[str, Sequence[str]] = LANGUAGE_PROFILE) -> Column:
    """``struct<language, confidence>`` by the share of a language's function words among all words.

    The highest share wins, the alphabetically first language among equals; ``unknown`` with 0.0 without any hit.
    """
    from provena.functions.text import terms

    def hits_of(tokens: Column, lang: str, ws: Sequence[str]) -> Column:
        return F.struct(F.size(F.filter(tokens, lambda t: t.isin(*ws))).alias("hits"), F.lit(lang).alias("lang"))

    def score(tokens: Column) -> Column:
        n = F.size(tokens)
        scores = F.array(*[hits_of(tokens, lang, ws) for lang, ws in sorted(profile.items())])
        best = F.aggregate(
            scores,
            F.struct(F.lit(0).alias("hits"), F.lit("unknown").alias("lang")),
            lambda acc, s: F.when(s["hits"] > acc["hits"], s).otherwise(acc),
        )
        return F.struct(
            best["lang"].alias("language"),
            F.when(n > 0, F.bround(best["hits"] / n, 4)).otherwise(F.lit(0.0)).alias("confidence"),
        )

    return F.element_at(F.transform(F.array(terms(text)), score), 1)


def tier1(text: Column, actual_sha256: Column, recorded_sha256: Column) -> Column:
    """Facts: text was extracted, and the bytes still match the recorded hash."""
    return F.struct(
        F.coalesce(F.length(text) > 0, F.lit(False)).alias("extraction_ok"),
        F.coalesce(actual_sha256 == recorded_sha256, F.lit(False)).alias("integrity_ok"),
    )


def tier1_reason(t1: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(~t1["extraction_ok"], F.lit("extraction failed or produced an empty file")),
        F.when(~t1["integrity_ok"], F.lit("SHA-256 no longer matches the raw file")),
    )


def drift(text: Column, baseline: Column, tracked: Column) -> Column:
    """Null for untracked sources or without a baseline, else ``struct<drifted, expected, actual>``."""
    actual = content_sha256(text)
    return F.when(
        tracked & baseline.isNotNull(),
        F.struct((actual != baseline).alias("drifted"), baseline.alias("expected"), actual.alias("actual")),
    )


def drift_status(text: Column, baseline: Column, tracked: Column) -> Column:
    """untracked / bootstrap (no baseline yet: record it) / verified / drifted."""
    return (
        F.when(~tracked, "untracked")
        .when(baseline.isNull(), "bootstrap")
        .when(content_sha256(text) == baseline, "verified")
        .otherwise("drifted")
    )


class ContentDriftError(RuntimeError):
    """Tracked documents without a baseline, or with another content than recorded."""


def require_verified(statuses: DataFrame, status: str = "status") -> None:
    """Fail the run if any document (doc_id, ``status``) is neither untracked nor verified; the others have been dealt with by then."""
    bad = statuses.where(~F.coalesce(F.col(status).isin("untracked", "verified"), F.lit(False)))
    n, first = bad.agg(F.count(F.lit(1)), F.min(F.struct(F.col("doc_id").cast("string"), status))).first()
    if n:
        raise ContentDriftError(f"{n} document(s) not verified, the first one {first[0]}: {first[1]}")


def rehydration_status(text: Column, baseline: Column, tracked: Column) -> Column:
    """The hard form of the same check: anything but untracked and verified is fatal for the document."""
    return (
        F.when(~tracked, "untracked")
        .when(baseline.isNull(), "no_baseline")
        .when(content_sha256(text) == baseline, "verified")
        .otherwise("mismatch")
    )


def tier2_flags(
    language: Column, n_words: Column, near_count: Column, near_first: Column, drifted: Column
) -> Column:
    """Flags for human review, in checking order. Never a reason to drop a document."""
    return F.array_compact(
        F.array(
            F.when(
                language != REQUIRED_LANGUAGE,
                F.concat(F.lit("language detected as '"), language, F.lit("', not English")),
            ),
            F.when(
                n_words < MIN_WORD_COUNT,
                F.concat(F.lit("only "), n_words.cast("string"), F.lit(f" words (below the {MIN_WORD_COUNT} minimum)")),
            ),
            F.when(
                near_count > 0,
                F.concat(
                    F.lit("near-duplicate of "), near_count.cast("string"), F.lit(" document(s), group of "),
                    near_first.cast("string"),
                ),
            ),
            F.when(drifted, F.lit("content hash drifted from recorded baseline")),
        )
    )


def validate(docs: DataFrame, near: DataFrame, tracked: Column) -> DataFrame:
    """Validation results, one row per document: tier 1, tier 2 for tier-1 survivors, flags.

    ``docs`` has doc_id, org, text, actual_sha256, recorded_sha256, content_baseline; ``near`` has doc_id,
    n_near, group_min over the tier-1 survivors.
    """
    d = docs.withColumn("tier1", tier1(F.col("text"), F.col("actual_sha256"), F.col("recorded_sha256")))
    d = d.withColumn("tier1_passed", F.col("tier1.extraction_ok") & F.col("tier1.integrity_ok"))
    d = d.select(
        "doc_id",
        "org",
        "tier1",
        "tier1_passed",
        F.when(~F.col("tier1_passed"), tier1_reason(F.col("tier1"))).alias("tier1_reason"),
        word_count("text").alias("_words"),
        detect_language("text").alias("_lang"),
        drift(F.col("text"), F.col("content_baseline"), tracked).alias("_drift"),
        topic_hints("text").alias("topic_hints"),
    ).join(near, "doc_id", "left")
    n_near = F.coalesce("n_near", F.lit(0).cast("bigint"))
    return d.select(
        "doc_id",
        "org",
        "tier1",
        "tier1_passed",
        "tier1_reason",
        F.when(
            F.col("tier1_passed"),
            F.struct(
                F.col("_words").alias("word_count"),
                F.col("_lang.language").alias("language"),
                F.col("_lang.confidence").alias("language_confidence"),
                (F.col("_lang.language") == REQUIRED_LANGUAGE).alias("language_ok"),
                (F.col("_words") >= MIN_WORD_COUNT).alias("length_ok"),
                n_near.alias("near_duplicates"),
                F.col("_drift").alias("content_drift"),
            ),
        ).alias("tier2"),
        F.when(
            F.col("tier1_passed"),
            tier2_flags(
                F.col("_lang.language"), F.col("_words"), n_near, F.col("group_min"),
                F.coalesce("_drift.drifted", F.lit(False)),
            ),
        ).alias("tier2_flags"),
        "topic_hints",
    )
