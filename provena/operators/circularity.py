"""Questions that repeat descriptive wording of the passage they were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import col

N_GRAM = 4  # fixed value
# Words that do not break a proper name, and terms of art that may be repeated.
FUNCTION_WORDS = ("a", "an", "the", "of", "in", "on", "for", "to", "and", "or", "at", "by")
TERMS_OF_ART = (
    "web connectivity test", "control measurement", "freedom on the net", "test helper",
    "confirmed anomaly", "false positive", "false negative", "ooni probe", "keepiton",
)
TOKEN = r"[A-Za-z']+|\d+"  # fixed value


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"({TOKEN})"), F.lit(1))


def _ngrams(toks: Column, n: int) -> Column:
    count = F.size(toks) - (n - 1)
    empty = F.array().cast("array<array<string>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(toks, i, F.lit(n)))).otherwise(empty)


def exempt(gram: Column) -> Column:
    """A term of art, or only capitalized words, numbers and function words."""
    lower = F.transform(gram, F.lower)
    named = F.forall(
        gram, lambda t: F.lower(t).isin(*FUNCTION_WORDS) | F.rlike(t, F.lit("^[A-Z]")) | F.rlike(t, F.lit("^[0-9]+$"))
    )
    return F.array_join(lower, " ").isin(*TERMS_OF_ART) | named


def ngrams(text: str | Column, n: int = N_GRAM, drop_exempt: bool = False) -> Column:
    """Lower-cased n-grams in text order; exempt ones left out on the passage side only."""
    grams = F.element_at(F.transform(F.array(tokens(text)), lambda t: _ngrams(t, n)), 1)
    if drop_exempt:
        grams = F.filter(grams, lambda g: ~exempt(g))
    return F.transform(grams, lambda g: F.lower(F.array_join(g, " ")))


def flagged_phrase(question: str, passage: str, n: int = N_GRAM) -> Column:
    """First n-gram of the question that the passage shares, or null."""
    shared = F.array_intersect(ngrams(question, n), ngrams(passage, n, drop_exempt=True))
    return F.when(F.size(shared) > 0, F.element_at(shared, 1))


def check_questions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``flagged_phrase`` and ``outcome``: dropped, kept, or unverifiable (passage missing; kept as well)."""
    c = chunks.select(F.col("chunk_id").alias("correct_chunk_id"), F.col("text").alias("_passage"))
    j = questions.join(c, "correct_chunk_id", "left").withColumn(
        "flagged_phrase", F.when(F.col("_passage").isNotNull(), flagged_phrase("question", "_passage"))
    )
    outcome = F.when(F.col("_passage").isNull(), "unverifiable").when(F.col("flagged_phrase").isNotNull(), "dropped").otherwise("kept")
    return j.withColumn("outcome", outcome).drop("_passage")


def filter_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total_before"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"),
        F.count_if(F.col("outcome") != "dropped").alias("kept"),
        F.count_if(F.col("outcome") == "unverifiable").alias("unverifiable"),
    )
