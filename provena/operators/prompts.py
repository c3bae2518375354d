"""Prompt texts and parsing of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import WS, col, strip, whole_json

# Separators, labels and verdicts.
EXCERPT_JOIN = "\n\n---\n\n"
NO_EXCERPTS = "(no cited excerpts)"
VERDICTS = ("supported", "partial", "unsupported")
KEYWORD_ORDER = ("unsupported", "partial", "supported")
REASON_LIMIT = 300
# Fixed value: what stands for a missing field in a line of text.
MISSING = "None"
# Fixed value: the heading after which the answer starts, with or without markdown around it.
ANSWER_HEADING = rf"(?sid)\A.*?(?m:^){WS}*#{{0,6}}{WS}*\**{WS}*ANSWER{WS}*\**{WS}*:?{WS}*(?m:$)(.*)\z"


def user_prompts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt): the question and its numbered excerpts in rank order.

    ``results`` has query_id, rank, organization, text. The number of an excerpt is its rank.
    """
    org, text = F.coalesce("organization", F.lit(MISSING)), F.coalesce("text", F.lit(MISSING))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (organization: "), org, F.lit(")\n"), text)
    rows = results.select("query_id", F.struct("rank", line.alias("line")).alias("_l"))
    body = rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n\n").alias("_b")
    )
    return queries.select("query_id", F.col("text").alias("_q")).join(body, "query_id").select(
        "query_id", F.concat(F.lit("Question: "), "_q", F.lit("\n\nExcerpts:\n\n"), "_b").alias("prompt")
    )


def judge_prompt(claim: str, excerpts: str) -> Column:
    body = F.when(F.size(excerpts) == 0, F.lit(NO_EXCERPTS)).otherwise(F.array_join(excerpts, EXCERPT_JOIN))
    return F.concat(F.lit("Claim:\n"), F.col(claim), F.lit("\n\nCited excerpt(s):\n\n"), body)


def unfence(raw: str | Column) -> Column:
    """Strip a code fence and its language word."""
    t = strip(raw)
    bare = F.regexp_replace(t, r"^`+|`+\z", "")
    bare = F.when(F.startswith(F.lower(bare), F.lit("json")), F.substring(bare, 5, 2**31 - 1)).otherwise(bare)
    return F.when(F.startswith(t, F.lit("```")), strip(bare)).otherwise(t)


def json_object(text: Column) -> Column:
    """The text as one JSON object, strictly: null for single quotes, for anything after the object and for other values."""
    js = whole_json(text)
    return F.when(F.startswith(F.schema_of_variant(js), F.lit("OBJECT")), js)


def text_field(js: Column, name: str) -> Column:
    """A text field of an object, empty where it is missing; null where it holds anything but text."""
    value = F.try_variant_get(js, f"$.{name}", "variant")
    return F.when(value.isNull(), F.lit("")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get(js, f"$.{name}", "string"))


def parse_verdict(raw: str | Column) -> Column:
    """``struct<verdict, reason>``: a JSON object with a known verdict and a text as reason, else the first keyword found, else unsupported."""
    js = json_object(unfence(raw))
    verdict, reason = F.lower(strip(text_field(js, "verdict"))), strip(text_field(js, "reason"))
    low = F.lower(col(raw))
    word = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEYWORD_ORDER])
    cut = F.substring(strip(raw), 1, REASON_LIMIT)
    return (
        F.when(js.isNotNull() & verdict.isin(*VERDICTS) & reason.isNotNull(), F.struct(verdict.alias("verdict"), reason.alias("reason")))
        .when(word.isNotNull(), F.struct(word.alias("verdict"), cut.alias("reason")))
        .otherwise(
            F.struct(F.lit("unsupported").alias("verdict"), F.concat(F.lit("[unparseable judge response] "), cut).alias("reason"))
        )
    )


def parse_disagreement(raw: str | Column) -> Column:
    """``struct<disagree, fact_compared>`` of a pairwise check; unparseable is no disagreement."""
    t = F.regexp_replace(strip(raw), r"^`+|`+\z", "")
    t = strip(F.regexp_replace(t, r"^json", ""))
    js = json_object(t)
    return F.struct(
        F.coalesce(F.try_variant_get(js, "$.disagree", "boolean"), F.lit(False)).alias("disagree"),
        F.when(js.isNull(), F.lit("unparseable")).otherwise(F.try_variant_get(js, "$.fact_compared", "string")).alias("fact_compared"),
    )


def answer_section(raw: str | Column) -> Column:
    """Text after the answer heading, stripped; null where there is none, which rejects the row."""
    c = col(raw)
    return F.when(F.rlike(c, F.lit(ANSWER_HEADING)), strip(F.regexp_extract(c, ANSWER_HEADING, 1)))


def unpack_excerpts(raw: str | Column) -> Column:
    """A JSON list of excerpts as delimited text; anything else passes through."""
    c = col(raw)
    items = F.from_json(c, "array<string>")
    blocks = F.transform(
        items, lambda x, i: F.concat(F.lit("--- excerpt "), (i + 1).cast("string"), F.lit(" ---\n"), x)
    )
    is_list = F.startswith(strip(c), F.lit("[")) & items.isNotNull()
    return F.when(is_list, F.array_join(blocks, "\n\n")).otherwise(c)
