"""Page provenance: character ranges of pages and the pages a chunk overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINER = "\n\n"  # fixed value


def page_breakpoints(pages: DataFrame) -> DataFrame:
    """(doc_id, page, char_start, char_end) of the non-empty pages joined by a blank line; ends exclusive.

    ``pages`` has doc_id, page, text. The joiner belongs to no page.
    """
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text")
    start = F.coalesce(F.sum(n + len(JOINER)).over(w), F.lit(0)).cast("int")
    return pages.where(n > 0).select("doc_id", "page", start.alias("char_start"), n.alias("_n")).select(
        "doc_id", "page", "char_start", (F.col("char_start") + F.col("_n")).alias("char_end")
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, breakpoints): the joined text of a document and its page ranges."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), JOINER)
    body = pages.where(F.length("text") > 0).groupBy("doc_id").agg(text.alias("text"))
    marks = page_breakpoints(pages).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "char_start", "char_end"))).alias("breakpoints")
    )
    return body.join(marks, "doc_id").withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", ""))


def page_range(breakpoints: str, start: str, end: str) -> Column:
    """Sorted distinct pages of an array of breakpoints that overlap [start, end); null when none do."""
    hit = F.filter(F.col(breakpoints), lambda b: (b["char_start"] < F.col(end)) & (b["char_end"] > F.col(start)))
    pages = F.array_sort(F.array_distinct(F.transform(hit, lambda b: b["page"])))
    return F.when(F.size(pages) > 0, pages)


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs with equal ``key`` whose [char_start, char_end) and [page_start, page_end) overlap.

    Both sides are cut into stretches of ``width`` characters and joined on (key, stretch), so long documents
    are not compared range by range. A pair meets once: in the first stretch both share.
    """

    def cut(df: DataFrame, s: str, e: str, out: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)
        return df.where(F.col(s) < F.col(e)).withColumn(out, F.explode(F.sequence(first, last)))

    a = cut(left, "char_start", "char_end", "_z")
    b = cut(right, "page_start", "page_end", "_z")
    shared = F.floor(F.greatest("char_start", "page_start") / width)
    return a.join(b, [key, "_z"]).where(
        (F.col("page_start") < F.col("char_end"))
        & (F.col("page_end") > F.col("char_start"))
        & (F.col("_z") == shared)
    ).drop("_z")


def chunk_pages(chunks: DataFrame, breakpoints: DataFrame, width: int = 1500) -> DataFrame:
    """(chunk_id, pages): sorted page numbers of each chunk, null where the document has no page data."""
    marks = breakpoints.select(
        "doc_id", "page", F.col("char_start").alias("page_start"), F.col("char_end").alias("page_end")
    )
    hit = overlap_join(chunks.select("doc_id", "chunk_id", "char_start", "char_end"), marks, "doc_id", width)
    pages = hit.groupBy("chunk_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return chunks.select("chunk_id").join(pages, "chunk_id", "left")
