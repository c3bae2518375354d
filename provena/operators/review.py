"""Answer quality: citation precision, reviewer agreement, arms of a comparison, cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.prompts import VERDICTS

# Price per thousand prompt and completion tokens.
MODEL_RATES = {
    "gpt-5.4-mini": (0.00025, 0.00100),
    "gpt-5.4": (0.00250, 0.01000),
}
MIN_AGREEMENT = 0.90
MIN_DISAGREEMENTS = 10


class UnknownModelError(ValueError):
    """A model without a rate: never a silent zero."""


def _per_and_all(df: DataFrame, column: str, aggs: list[Column]) -> DataFrame:
    return (
        df.groupingSets([[column], []], column)
        .agg(F.grouping(column).alias("_all"), *aggs)
        .withColumn(column, F.when(F.col("_all") == 1, "overall").otherwise(F.col(column)))
        .drop("_all")
    )


def precision(supported: Column, partial: Column, unsupported: Column) -> Column:
    """Supported share of the three verdicts; null when nothing was judged."""
    return F.try_divide(supported, supported + partial + unsupported)


def citation_precision(judgments: DataFrame, by: str = "category") -> DataFrame:
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    agg = _per_and_all(judgments, by, counts)
    return agg.withColumn("precision", precision(*[F.col(v) for v in VERDICTS]))


def mechanical_counts(answers: DataFrame, by: str = "category") -> DataFrame:
    """Invalid markers and unsupported paragraphs, by category and overall."""
    return _per_and_all(
        answers,
        by,
        [
            F.coalesce(F.sum(F.size("invalid_markers")), F.lit(0)).alias("invalid_markers"),
            F.coalesce(F.sum(F.size("unsupported_paragraphs")), F.lit(0)).alias("unsupported_paragraphs"),
        ],
    )


def confusion(rows: DataFrame) -> DataFrame:
    """(verdict, human, n) over the full grid of verdicts, zeros included. Other human values are not scored."""
    j, h = F.lower(F.trim("verdict")), F.lower(F.trim(F.coalesce("human_verdict", F.lit(""))))
    counts = rows.select(j.alias("verdict"), h.alias("human")).groupBy("verdict", "human").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.createDataFrame([(a, b) for a in VERDICTS for b in VERDICTS], "verdict string, human string")
    return F.broadcast(grid).join(counts, ["verdict", "human"], "left").select("verdict", "human", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row of scores: counts, raw agreement, kappa (null if undefined) and the go decision."""
    j, h = F.lower(F.trim("verdict")), F.lower(F.trim(F.coalesce("human_verdict", F.lit(""))))
    d = rows.select(j.alias("v"), h.alias("h"))
    scored = F.col("h").isin(*VERDICTS)
    cells = [
        F.count_if((F.col("v") == a) & (F.col("h") == b)).alias(f"{a}_{b}") for a in VERDICTS for b in VERDICTS
    ]
    t = d.agg(F.count_if(scored).alias("n_scored"), F.count_if(~scored).alias("n_missing"), *cells)
    n = F.col("n_scored")
    agree = sum((F.col(f"{v}_{v}") for v in VERDICTS), F.lit(0))
    row = {v: sum((F.col(f"{v}_{b}") for b in VERDICTS), F.lit(0)) for v in VERDICTS}
    column = {v: sum((F.col(f"{a}_{v}") for a in VERDICTS), F.lit(0)) for v in VERDICTS}
    in_grid = sum((row[v] for v in VERDICTS), F.lit(0))
    po = F.try_divide(agree, in_grid)
    pe = sum((F.try_divide(row[v], in_grid) * F.try_divide(column[v], in_grid) for v in VERDICTS), F.lit(0.0))
    raw = F.try_divide(agree, n)
    return t.select(
        "n_scored",
        "n_missing",
        (n - agree).alias("n_disagree"),
        raw.alias("raw_agreement"),
        F.when(pe != 1, F.try_divide(po - pe, 1 - pe)).alias("kappa"),
        (n - agree < MIN_DISAGREEMENTS).alias("kappa_uninformative"),
        F.col("supported_unsupported").alias("supported_but_human_unsupported"),
        (F.coalesce(raw >= MIN_AGREEMENT, F.lit(False)) & (F.col("supported_unsupported") == 0)).alias("go"),
    )


def verdict_transitions(judgments: DataFrame, old: str, new: str) -> DataFrame:
    """How verdicts moved between two rubric versions: one row per old verdict, a column per new one."""
    a = judgments.where(F.col("prompt_version") == old).select("judgment_id", F.col("verdict").alias("old_verdict"))
    b = judgments.where(F.col("prompt_version") == new).select("judgment_id", F.col("verdict").alias("_new"))
    return a.join(b, "judgment_id").groupBy("old_verdict").agg(
        *[F.count_if(F.col("_new") == v).alias(v) for v in VERDICTS]
    )


def shape_by_verdict(judgments: DataFrame) -> DataFrame:
    """Claims by the number of passages they cite (none, one, several): a row per shape, a column per verdict, and the share supported."""
    n = F.size(F.coalesce("markers", F.array().cast("array<int>")))
    shape = F.when(n == 0, "uncited").when(n == 1, "single").otherwise("multiple")
    return judgments.groupBy(shape.alias("shape")).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.try_divide(F.count_if(F.col("verdict") == "supported"), F.count_if(F.col("verdict").isin(*VERDICTS))).alias("share_supported"),
    )


def three_way_view(rows: DataFrame, second: DataFrame) -> DataFrame:
    """Calibration rows with a second rubric's verdict and the reviewer's, placeholders for what is missing."""
    s = second.select("judgment_id", F.col("verdict").alias("_v2"), F.col("reason").alias("_r2"))
    blank = F.trim(F.coalesce("reviewer_verdict", F.lit(""))) == ""
    return rows.join(s, "judgment_id", "left").select(
        "judgment_id",
        F.col("verdict").alias("v1_verdict"),
        F.coalesce("_v2", F.lit("(not found)")).alias("v2_verdict"),
        F.coalesce("_r2", F.lit("")).alias("v2_reason"),
        F.when(blank, F.lit("(not reviewed)")).otherwise(F.trim("reviewer_verdict")).alias("reviewer_verdict"),
        badge(F.col("verdict")).alias("badge"),
    )


def badge(verdict: Column) -> Column:
    v = F.lower(F.trim(verdict))
    return F.when(v.isin(*VERDICTS), F.concat(F.lit("badge-"), v)).otherwise(F.lit("badge-unknown"))


def arm_stats(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per arm: verdict counts, precision, claims per answer, abstention rate and tokens of rows that have them."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    r = records.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_answers"),
        mean("n_claims").alias("claims_per_answer"),
        mean(F.col("abstained").cast("int")).alias("abstention_rate"),
        mean("prompt_tokens").alias("mean_prompt_tokens"),
        mean("completion_tokens").alias("mean_completion_tokens"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("bigint").alias("total_completion_tokens"),
    )
    j = judgments.groupBy("arm").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    out = r.join(j, "arm", "left").na.fill(0, list(VERDICTS))
    return out.withColumn("precision", precision(*[F.col(v) for v in VERDICTS]))


def run_totals(answers: DataFrame) -> DataFrame:
    """Calls, failures and token totals of a run; failed rows have no answer."""
    return answers.agg(
        F.count_if(F.col("answer_markdown").isNotNull()).alias("n_calls"),
        F.count_if(F.col("answer_markdown").isNull()).alias("n_failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("bigint").alias("completion_tokens"),
    )


def cost_usd(model: str, prompt: str, completion: str, rates: Mapping[str, tuple[float, float]] = MODEL_RATES) -> Column:
    """Estimated cost; null for a model without a rate (see ``require_known_models``)."""
    m = F.col(model)
    out = F
    for name, (p, c) in rates.items():
        out = out.when(m == name, F.col(prompt) / 1000 * F.lit(p) + F.col(completion) / 1000 * F.lit(c))
    return out


def require_known_models(df: DataFrame, model: str = "model", rates: Mapping[str, tuple[float, float]] = MODEL_RATES) -> None:
    """Fail before anything is written when a model has no rate."""
    bad = df.where(~F.coalesce(F.col(model), F.lit("")).isin(*rates)).select(model).take(1)
    if bad:
        raise UnknownModelError(f"no rate for model {bad[0][0]!r}; known: {sorted(rates)}")


def behavioral_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(F.col("ok")).alias("n_pass"), F.count(F.lit(1)).alias("n"))
