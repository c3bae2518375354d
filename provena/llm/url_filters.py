"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest. JVM-side throughout.

The trees are Spark's own, trained on a bounded sample of labelled URLs whose order is fixed, so that reruns agree.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import bind
from provena.session import written_table

# The rules of the driver's pages, as (verdict, host followed by path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "upper_ratio", "symbol_ratio", "host_hyphens",
    "host_digits", "entropy", "host_entropy", "parameters", "has_fragment", "longest_run", "encoded", "suffix_rate", "suffix_share",
]


def parts(url: Column | str) -> tuple[Column, Column]:
    """(host, path): the host in lower case (A-Z), from the first ``://`` to ``/``, ``?``, ``#`` or the end; then the path to ``?`` or ``#``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host, all subdomains, and paths that begin with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, 0 for an empty text."""
    def of(chars: Column) -> Column:
        # sorted characters: a run ends where the next one differs, so the length of each run is a count
        n = F.size(chars)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(chars, i) != F.get(chars, i - 1)))
        runs = F.zip_with(ends, F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda e, s: (e - s) / n)
        return F.aggregate(runs, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return F.when(F.length(text) > 0, bind(F.array_sort(F.split(text, "")), of)).otherwise(0.0)


def with_features(df: DataFrame) -> DataFrame:
    """Adds the lexical features of (_url, _host, _path), but for the statistics of the suffix."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    n = F.greatest(F.length(url), F.lit(1))

    def count(pattern: str, of: Column = url) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count("[^/]+", path),
        "labels": count("[^.]+", host),
        "digit_ratio": count("[0-9]") / n,
        "upper_ratio": count("[A-Z]") / n,
        "symbol_ratio": count("[^A-Za-z0-9/.:]") / n,
        "host_hyphens": count("-", host),
        "host_digits": count("[0-9]", host),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(count("&", query) + 1),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "longest_run": F.aggregate(F.split(url, "[^A-Za-z]+"), F.lit(0), lambda m, w: F.greatest(m, F.length(w))).cast("double"),
        "encoded": count("%[0-9A-Fa-f]{2}"),
    })


@dataclass(frozen=True)
class UrlModel:
    """Trees and the suffix table (suffix, rate of blocked URLs, share of all), or no trees where the labels are all alike."""

    trees: GBTClassificationModel | None
    suffixes: dict[str, tuple[float, float]]
    prior: float

    def score(self, urls: DataFrame, url: str = "url", out: str = "block_score") -> DataFrame:
        """``urls`` with the probability that a URL is to be blocked. A null URL is scored as an empty one."""
        names = urls.columns
        clash = {n for n in names if n.startswith("_") or n in FEATURES or n in ("features", "rawPrediction", "probability", "prediction")}
        if clash:  # the trees' columns must not meet the table's
            renamed = urls.select(*[F.col(f"`{n}`").alias(f"given {i}") for i, n in enumerate(names)])
            scored = self.score(renamed, f"given {names.index(url)}", "block score")
            kept = [F.col(f"given {i}").alias(n) for i, n in enumerate(names) if n != out]
            return scored.select(*kept, F.col("block score").alias(out))
        text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
        host, path = parts(text)
        if self.trees is None:
            return urls.withColumn(out, F.lit(self.prior))
        df = with_features(urls.withColumns({"_url": text, "_host": host, "_path": path}))
        rate, share = F.lit(self.prior), F.lit(0.0)
        for name, (r, s) in self.suffixes.items():
            rate = F.when(suffix(host) == name, r).otherwise(rate)
            share = F.when(suffix(host) == name, s).otherwise(share)
        df = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df.withColumns({"suffix_rate": rate, "suffix_share": share}))
        df = self.trees.transform(df).withColumn(out, vector_to_array("probability")[1])
        return df.select(*[F.col(f"`{n}`") for n in names if n != out], out)


def train(
    labelled: DataFrame, url: str = "url", label: str = "blocked", rows: int = 50_000, trees: int = 20, depth: int = 4,
    max_suffixes: int = 50, smoothing: float = 20.0, seed: int = 3,
) -> UrlModel:
    """Fit on about ``rows`` labelled URLs at most, chosen by a hash of the URL. Null URLs and labels are no examples.

    The suffix statistics come from all labelled rows: the ``max_suffixes`` most frequent suffixes have a row of their own,
    with a rate smoothed towards the overall one; the others share the overall rate.
    """
    given = labelled.where(F.col(url).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(url).alias("_url"), F.col(label).cast("double").alias("_y")
    )
    host, path = parts("_url")
    given = given.withColumns({"_host": host, "_path": path})
    counts = {r[0]: r[1] for r in given.groupBy("_y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1.0, 0) / total if total else 0.0
    if len(counts) < 2:
        return UrlModel(None, {}, prior)
    top = (
        given.groupBy(suffix(F.col("_host")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"))
        .orderBy(F.desc("n"), "s").limit(max_suffixes).collect()
    )
    suffixes = {r["s"]: ((r["y"] + smoothing * prior) / (r["n"] + smoothing), r["n"] / total) for r in top}
    sample = given.where(F.pmod(F.xxhash64(F.lit(seed), "_url"), F.lit(1 << 30)) < (1 << 30) * min(1.0, rows / total))
    rate, share = F.lit(prior), F.lit(0.0)
    for name, (r, s) in suffixes.items():
        rate = F.when(suffix(F.col("_host")) == name, r).otherwise(rate)
        share = F.when(suffix(F.col("_host")) == name, s).otherwise(share)
    sample = with_features(sample).withColumns({"suffix_rate": rate, "suffix_share": share})
    # The same rows in the same partitions and order in every run: the trees' split points are sampled from them.
    fixed = written_table(sample.select("_url", "_y", *FEATURES)).repartition(8, F.xxhash64("_url")).sortWithinPartitions("_url", "_y")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(fixed)
    fit = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    return UrlModel(fit.fit(vectors.select("_y", "features")), suffixes, prior)


def judge(urls: DataFrame, model: UrlModel, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``urls`` with host, path, rule, block_score and verdict: the rule's, else block from a score of 0.5 on."""
    urls = urls.drop("host", "path", "rule", "verdict")
    host, path = parts(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    scored = model.score(urls, url).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, learned))
