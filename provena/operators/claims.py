"""Claims in answers: cited sentences, their passages and the judgments on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import WS, bind, col, strip
from provena.operators.citations import markers

# A sentence ends at terminal punctuation and takes the markers that follow it; what is left at the
# end of the text without punctuation is one more sentence. Possessive, so a long rest is read once.
SENTENCE = rf"[^.!?]*+(?:[.!?]++(?:{WS}*+\[\d+\])*+|\z)"
DECIMAL = r"(?<=\d)\.(?=\d)"
MASK = "\x00"


def sentences(text: str | Column) -> Column:
    """Stripped sentences and the unterminated rest, decimals kept whole."""
    masked = F.regexp_replace(col(text), DECIMAL, MASK)
    found = F.regexp_extract_all(masked, F.lit(f"({SENTENCE})"), F.lit(1))
    return F.filter(F.transform(found, lambda s: strip(F.replace(s, F.lit(MASK), F.lit(".")))), lambda s: s != "")


def extract_claims(parsed: DataFrame, query: str = "question_id", answer: str = "answer_markdown") -> DataFrame:
    """(question..., claim_index, claim_text, markers): sentences with at least one valid marker.

    ``parsed`` has ``citations``; markers are distinct in first-seen order, invalid ones are not counted.
    """
    valid = F.transform("citations", lambda c: c["marker"].cast("bigint"))
    claims = bind(
        valid,
        lambda ok: F.filter(
            F.transform(
                sentences(answer),
                lambda s: F.struct(s.alias("claim_text"), F.array_intersect(markers(s), ok).alias("markers")),
            ),
            lambda c: F.size(c["markers"]) > 0,
        ),
    )
    return parsed.select("*", F.posexplode(claims).alias("claim_index", "_c")).select(
        *parsed.columns, "claim_index", F.col("_c.claim_text").alias("claim_text"), F.col("_c.markers").alias("markers")
    )


def judgment_id(question: Column, index: Column, arm: Column | None = None) -> Column:
    """``question::claimNNN``, with the arm in between for an A/B run."""
    if arm is None:
        return F.format_string("%s::claim%03d", question.cast("string"), index)
    return F.format_string("%s::%s::claim%03d", question.cast("string"), arm, index)


def with_chunk_texts(claims: DataFrame, chunks: DataFrame, key: str = "judgment_id") -> DataFrame:
    """Add ``cited_chunk_texts``: the distinct cited passages in marker order, those without text dropped.

    A passage cited by very many claims is one row on the chunk side; Spark splits the claim side of such a key.
    """
    ids = F.array_distinct(
        F.transform("markers", lambda m: F.element_at(F.filter("citations", lambda c: c["marker"] == m), 1)["chunk_id"])
    )
    rows = claims.select(key, F.posexplode(ids).alias("_p", "chunk_id"))
    texts = rows.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda s: s["_t"]).alias("cited_chunk_texts")
    )
    empty = F.array().cast("array<string>")
    return claims.join(texts, key, "left").withColumn("cited_chunk_texts", F.coalesce("cited_chunk_texts", empty))


def pending(items: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Items not done yet, by id; at most ``limit`` of them in id order."""
    left = items.join(done.select(key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)
