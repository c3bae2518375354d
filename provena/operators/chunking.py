"""Fixed overlapping windows over documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import col

# Window length, step between window starts, strategy name.
CHUNK_SIZE = 1500
CHUNK_STEP = 750
STRATEGY = "fixed_overlap"


def window_count(n: str | Column, size: int = CHUNK_SIZE, step: int = CHUNK_STEP) -> Column:
    """How many windows a text of ``n`` characters has; the last one ends exactly at ``n``."""
    n = col(n)
    full = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)) + 1
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(full, F.ceil(n / F.lit(step)))).cast("int")


def windows(n: str | Column, size: int = CHUNK_SIZE, step: int = CHUNK_STEP) -> Column:
    """``array<struct<chunk_index, char_start, char_end>>``, ends exclusive."""
    n = col(n)
    count = window_count(n, size, step)
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("chunk_index"),
            (i * step).alias("char_start"),
            F.least(i * step + size, n).cast("int").alias("char_end"),
        ),
    )


def chunk_documents(
    docs: DataFrame,
    keep: Sequence[str] = (),
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    step: int = CHUNK_STEP,
) -> DataFrame:
    """One row per window: chunk_id, doc_id, chunk_index, char_start, char_end, text, total_chunks and ``keep``.

    The text is cut once into pieces of gcd(size, step) characters and each window joins its pieces, so a
    document costs time linear in its length. No shuffle.
    """
    piece = math.gcd(size, step)
    keep = [k for k in keep if k not in (doc_id, text)]
    pre = docs.select(
        F.col(doc_id).alias("doc_id"),
        *keep,
        F.length(text).alias("_n"),
        F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(.{{1,{piece}}})"), F.lit(1)).alias("_p"),
    )
    cut = F.transform(
        windows("_n", size, step),
        lambda w: F.struct(
            w["chunk_index"].alias("chunk_index"),
            w["char_start"].alias("char_start"),
            w["char_end"].alias("char_end"),
            F.array_join(
                F.slice("_p", w["chunk_index"] * (step // piece) + 1, F.lit(size // piece)), ""
            ).alias("text"),
        ),
    )
    rows = pre.select("doc_id", *keep, window_count("_n", size, step).alias("total_chunks"), F.explode(cut).alias("_w"))
    return rows.select(
        F.format_string("%s-chunk-%04d", F.col("doc_id").cast("string"), F.col("_w.chunk_index")).alias("chunk_id"),
        "doc_id",
        F.col("_w.chunk_index").alias("chunk_index"),
        F.col("_w.char_start").alias("char_start"),
        F.col("_w.char_end").alias("char_end"),
        F.col("_w.text").alias("text"),
        "total_chunks",
        *keep,
    )


def chunk_total(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, step: int = CHUNK_STEP) -> Column:
    """Number of chunks of the whole corpus as a scalar subquery; nothing is collected."""
    return docs.agg(
        F.coalesce(F.sum(window_count(F.length(text), size, step)), F.lit(0)).cast("bigint").alias("n")
    ).scalar()


def chunking_block(corpus_version: str | Column, total: str | Column, run_date: str | Column) -> Column:
    """The stamp each chunked document carries."""
    return F.struct(
        F.lit(STRATEGY).alias("strategy"),
        F.lit(CHUNK_SIZE).alias("chunk_size"),
        F.lit(CHUNK_STEP).alias("chunk_step"),
        col(total).cast("int").alias("total_chunks"),
        (run_date if isinstance(run_date, Column) else F.lit(run_date)).alias("chunking_date"),
        col(corpus_version).alias("corpus_version"),
    )


def neighbor_chunk_ids(chunk_id: str | Column) -> Column:
    """Ids of the windows before and after, zero padding kept; none below 0; empty for other ids."""
    c = col(chunk_id)
    prefix = F.regexp_extract(c, r"^(.+-chunk-)(\d+)$", 1)
    digits = F.regexp_extract(c, r"^(.+-chunk-)(\d+)$", 2)
    i = digits.cast("bigint")
    width = F.length(digits)

    def at(v: Column) -> Column:
        s = v.cast("string")
        return F.concat(prefix, F.repeat(F.lit("0"), F.greatest(width - F.length(s), F.lit(0))), s)

    ids = F.array_compact(F.array(F.when(i > 0, at(i - 1)), at(i + 1)))
    return F.when(prefix == "", F.array().cast("array<string>")).otherwise(ids)


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("actual_chunks"))
