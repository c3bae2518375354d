"""Citation markers in answers and the passages they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.prompts import MISSING
from provena.functions.text import col, strip

MARKER = r"\[(\d+)\]"  # fixed value: a marker is a number in square brackets


def markers(text: str | Column) -> Column:
    """Marker numbers in text order, repeats kept. Digits beyond the range of a bigint are no passage: -1."""
    return F.transform(
        F.regexp_extract_all(col(text), F.lit(MARKER), F.lit(1)),
        lambda m: F.coalesce(m.try_cast("bigint"), F.lit(-1).cast("bigint")),
    )


def unsupported_paragraphs(text: str | Column) -> Column:
    """Stripped non-blank paragraphs without a marker of any kind."""
    paras = F.filter(F.split(col(text), "\n\n"), lambda p: (strip(p) != "") & ~F.rlike(p, F.lit(MARKER)))
    return F.transform(paras, lambda p: strip(p))


def retrieved_lists(results: DataFrame, query: str = "question_id") -> DataFrame:
    """The numbered passages of each question in rank order; bounded by the search depth."""
    fields = [c for c in results.columns if c != query]
    ordered = F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"])))
    return results.groupBy(query).agg(ordered.alias("retrieved"))


def parse_citations(answers: DataFrame, answer: str = "answer_markdown") -> DataFrame:
    """Add citations, invalid_markers and unsupported_paragraphs to rows that hold ``retrieved``.

    Marker n is the n-th passage. Citations are distinct and sorted by marker; invalid markers are distinct in
    the order they appear.
    """
    n = F.coalesce(F.size("retrieved"), F.lit(0))
    d = answers.withColumn("_m", F.array_distinct(markers(answer)))
    valid = F.array_sort(F.filter("_m", lambda m: (m >= 1) & (m <= n)))
    return d.select(
        "*",
        F.transform(
            valid,
            lambda m: F.struct(
                m.cast("int").alias("marker"),
                F.element_at("retrieved", m.cast("int"))["chunk_id"].alias("chunk_id"),
                F.element_at("retrieved", m.cast("int"))["doc_id"].alias("doc_id"),
                F.element_at("retrieved", m.cast("int"))["pages"].alias("pages"),
            ),
        ).alias("citations"),
        F.filter("_m", lambda m: ~((m >= 1) & (m <= n))).alias("invalid_markers"),
        unsupported_paragraphs(answer).alias("unsupported_paragraphs"),
    ).drop("_m")


def citation_rows(parsed: DataFrame, query: str = "question_id") -> DataFrame:
    """One row per citation."""
    return parsed.select(query, F.explode("citations").alias("_c")).select(query, "_c.*")


def page_phrase(pages: Column) -> Column:
    first, last = F.element_at(pages, 1).cast("string"), F.element_at(pages, -1).cast("string")
    return (
        F.when(F.coalesce(F.size(pages), F.lit(0)) == 0, F.lit(""))
        .when(F.size(pages) == 1, F.concat(F.lit(", p. "), first))
        .otherwise(F.concat(F.lit(", pp. "), first, F.lit("-"), last))
    )


def shown(field: str) -> Column:
    """A metadata field in a line: a missing one is said to be so, the line stays."""
    return F.coalesce(F.col(field).cast("string"), F.lit(MISSING))


def source_lines(cites: DataFrame, meta: DataFrame, query: str = "question_id") -> DataFrame:
    """(question_id, sources): one line per citation in marker order; a degraded line without metadata."""
    m = meta.select("doc_id", "organization", "title", "publication_date", "url")
    number = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "))
    line = F.when(
        F.col("organization").isNull(),
        F.concat(number, F.col("doc_id").cast("string"), F.lit(" (metadata unavailable), chunk "), "chunk_id", F.lit(".")),
    ).otherwise(
        F.concat(
            number, "organization", F.lit(', "'), shown("title"), F.lit('" ('), shown("publication_date"), F.lit(")"),
            page_phrase(F.col("pages")), F.lit(". "), shown("url"),
        )
    )
    lines = cites.join(m, "doc_id", "left").select(query, F.struct("marker", line.alias("line")).alias("_l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n")
    return lines.groupBy(query).agg(text.alias("sources"))


def sourcing(questions: DataFrame, cites: DataFrame, meta: DataFrame, query: str = "question_id") -> DataFrame:
    """Distinct organizations and documents of the cited passages, the footer sentence and the status word.

    Counts cover cited passages only. Documents without metadata count as documents, not as organizations.
    """
    docs = cites.select(query, "doc_id").distinct().join(
        meta.select("doc_id", "organization", F.left("publication_date", F.lit(4)).alias("year")), "doc_id", "left"
    )
    agg = docs.groupBy(query).agg(
        F.count_distinct("organization").alias("distinct_orgs"),
        F.count(F.lit(1)).alias("distinct_docs"),
        F.min("organization").alias("_org"),
        F.min("year").alias("_y0"),
        F.max("year").alias("_y1"),
    )
    d = questions.select(query).join(agg, query, "left").withColumn(
        "distinct_orgs", F.coalesce("distinct_orgs", F.lit(0))
    ).withColumn("distinct_docs", F.coalesce("distinct_docs", F.lit(0)))
    years = (
        F.when(F.col("_y0").isNull(), "date unknown").when(F.col("_y0") == F.col("_y1"), F.col("_y0")).otherwise(F.concat("_y0", F.lit("-"), "_y1"))
    )
    n, o = F.col("distinct_docs").cast("string"), F.col("distinct_orgs").cast("string")
    footer = (
        F.when(F.col("distinct_docs") == 0, F.lit("Sourcing: no citations were produced for this answer."))
        .when(
            F.col("distinct_docs") == 1,
            F.concat(
                F.lit("Sourcing: this answer cites a single document (from "),
                F.coalesce("_org", F.lit("an unknown organization")),
                F.lit("). No independent corroboration was found among the retrieved evidence for this question."),
            ),
        )
        .when(
            F.col("distinct_orgs") == 1,
            F.concat(
                F.lit("Sourcing: all cited evidence comes from one organization ("), "_org", F.lit("), across "), n,
                F.lit(" reports ("), years, F.lit(")."),
            ),
        )
        .otherwise(
            F.concat(F.lit("Sourcing: this answer cites "), n, F.lit(" documents from "), o, F.lit(" organizations ("), years, F.lit(")."))
        )
    )
    return d.select(query, "distinct_orgs", "distinct_docs", footer.alias("footer"), sourcing_status().alias("sourcing_status"))


def sourcing_status() -> Column:
    return (
        F.when(F.col("distinct_docs") == 0, "none")
        .when(F.col("distinct_docs") == 1, "thin")
        .when(F.col("distinct_orgs") == 1, "single_org")
        .otherwise("broad")
    )


def interaction_facts(parsed: DataFrame, meta: DataFrame, query: str = "question_id") -> DataFrame:
    """What the interaction log keeps of citations: summary, sorted organizations and counts."""
    c = parsed.select(query, F.explode("citations").alias("_c"), "retrieved").select(
        query, "_c.*", F.element_at("retrieved", F.col("_c.marker"))["score"].alias("score")
    )
    j = c.join(meta.select("doc_id", "organization"), "doc_id", "left")
    agg = j.groupBy(query).agg(
        F.array_sort(F.collect_list(F.struct("marker", "doc_id", F.col("organization").alias("org"), "score"))).alias("citations_summary"),
        F.array_sort(F.collect_set("organization")).alias("source_orgs"),
    )
    return parsed.select(
        query,
        F.size("citations").alias("citation_count"),
        F.size("invalid_markers").alias("invalid_marker_count"),
        F.size("unsupported_paragraphs").alias("unsupported_paragraph_count"),
        F.filter(F.transform("retrieved", lambda r: r["score"]), lambda s: s.isNotNull()).alias("retrieval_scores"),
    ).join(agg, query, "left")


def latency_ms(retrieval_ms: str = "retrieval_ms", llm_ms: str = "llm_ms") -> Column:
    """Time of an answer: search and model together; a part that was not measured counts as none, both missing as unknown."""
    known = F.coalesce(retrieval_ms, llm_ms).isNotNull()
    return F.when(known, F.coalesce(retrieval_ms, F.lit(0)) + F.coalesce(llm_ms, F.lit(0))).cast("int")


def is_abstention(citations: str = "citations") -> Column:
    """An answer abstains exactly when nothing valid is cited."""
    return F.size(citations) == 0
