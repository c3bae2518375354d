"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each n-gram's feature is its log-count ratio between toxic and
other training texts, if the text holds it, else zero; a logistic regression weighs the features. Counting and scoring
are Arrow batches inside tasks; the driver sees only the model: the ``features`` n-grams that tell the classes apart
most surely, and which of them each sampled text holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import bounded_sample
from provena.llm.kernels import char_grams, text_pieces


@dataclass(frozen=True)
class ToxicityModel:
    """``position[bucket]``: the feature of a hashed n-gram or -1; ``weight`` by feature (ratio times coefficient)."""

    position: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with the probability of being toxic in ``out`` (an existing column of that name is replaced).

        Every whole text is read. A null text counts as an empty one, whose score is the model's for a text without
        any n-gram. The id, source and language are no inputs.
        """
        docs = docs.drop(out)
        model = docs.sparkSession.sparkContext.broadcast((self.position, self.weight, self.bias, self.sizes, self.bits))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(probabilities(texts, *model.value), pa.float64())],
                    names=[*batch.schema.names, out],
                )

        return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def probabilities(
    texts: list[str], position: np.ndarray, weight: np.ndarray, bias: float, sizes: tuple[int, ...], bits: int
) -> np.ndarray:
    out = []
    for a, b in text_pieces(texts):
        doc, feature = present(texts[a:b], position, sizes, bits)
        z = np.bincount(doc, weight[feature], b - a)
        out.append(1 / (1 + np.exp(-np.clip(z + bias, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def present(texts: list[str], position: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the features that each text holds, each once."""
    pairs, width = [], int(position.max(initial=-1)) + 1
    for bucket, offsets in char_grams(texts, sizes, bits):
        feature = position[bucket]
        hit = np.flatnonzero(feature >= 0)
        doc = np.searchsorted(offsets, hit, "right") - 1
        pairs.append(doc * max(width, 1) + feature[hit])
    pair = np.unique(np.concatenate(pairs))
    return pair // max(width, 1), pair % max(width, 1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = 10_000,
    sizes: tuple[int, ...] = (3, 4, 5),
    bits: int = 20,
    features: int = 2048,
    smoothing: float = 1.0,
    penalty: float = 1e-4,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows: about ``rows`` of each class (``label`` 1 or 0) at most.

    Classes are weighed back to their full counts, so the score is a probability under the labels' own base rate.
    Rows with a null key or label are no examples; a key labelled more than once is toxic if any row says so.
    Without texts of both classes the score is the base rate of the labels, 0 if there are none.
    """
    given = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    given = given.groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    sample, counts = bounded_sample(given, "_y", "_k", rows)
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    bias = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (500.0 if rate == 1 else -500.0)
    plain = ToxicityModel(np.full(1 << bits, -1, np.int32), np.zeros(1), bias, sizes, bits)
    if len(counts) < 2:
        return plain
    # At most about 2 * rows ids and classes are broadcast; the texts stay where they are read.
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(sample), "_k").select("_y", "_t", "_k")
    present_rows = {r[0]: r[1] for r in texts.groupBy("_y").count().collect()}  # labels may name documents that are not here

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            ts, ys = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            for a, b in text_pieces(ts):
                for bucket, offsets in char_grams(ts[a:b], sizes, bits):
                    for i in range(b - a):
                        held[ys[a + i], np.unique(bucket[offsets[i] : offsets[i + 1]])] += 1
        seen = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(held[0, seen]), pa.array(held[1, seen])], names=["bucket", "n0", "n1"]
        )

    # A bounded number of texts in a fixed number of tasks: each task sends one row per n-gram it has seen.
    spread = texts.repartition(8, "_k")  # by key, so that copies of a text do not meet in one task
    n0, n1 = float(present_rows.get(0, 0)), float(present_rows.get(1, 0))
    if not n0 or not n1:
        return plain
    grams = (
        spread.mapInArrow(count, "bucket long, n0 long, n1 long")
        .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .withColumn("_p", (F.col("n0") + F.col("n1")) / (n0 + n1))
        .withColumn("_z", F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.col("_p") * F.greatest(F.lit(1e-9), 1 - F.col("_p"))))
        .orderBy(F.desc("_z"), "bucket").limit(features).select("bucket", "n0", "n1").toPandas()
    )
    position = np.full(1 << bits, -1, np.int32)
    position[grams["bucket"]] = np.arange(len(grams))
    ratio = np.log((grams["n1"].to_numpy() + smoothing) / (n1 + 2 * smoothing)) - np.log(
        (grams["n0"].to_numpy() + smoothing) / (n0 + 2 * smoothing)
    )
    lookup = docs.sparkSession.sparkContext.broadcast(position)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, rows_of = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in text_pieces(ts):
                doc, feature = present(ts[a:b], lookup.value, sizes, bits)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                rows_of += [feature[i:j].astype(np.int32) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f in rows_of], pa.binary())], names=["y", "f"]
            )

    known = spread.mapInArrow(design, "y int, f binary").toPandas()
    lookup.unpersist()
    y = known["y"].to_numpy(float)
    size = known["f"].map(len).to_numpy(np.int64) // 4
    feature = np.frombuffer(b"".join(known["f"]), np.int32)
    weight = np.where(y == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    coefficient, bias = logistic(size, feature, ratio, y, weight, penalty)
    return ToxicityModel(position, coefficient * ratio, bias, sizes, bits)


def logistic(
    size: np.ndarray, feature: np.ndarray, ratio: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 200,
    block: int = 1 << 19,
) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on the scaled features, by gradient steps with momentum and step sizes per feature.

    ``size`` features of each example follow one another in ``feature``. Sums are taken over blocks of examples with about
    ``block`` features, so that the driver holds little beside the features themselves.
    """
    n, k = len(y), len(ratio)
    weight = weight / max(weight.sum(), 1e-12)
    start = np.concatenate([[0], np.cumsum(size)])
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, start[-1] + 1, block)), n)) if n else np.zeros(1, np.int64)
    blocks = [(a, b, start[a], start[b]) for a, b in zip(np.append(0, cuts[cuts > 0])[:-1], cuts[cuts > 0], strict=True)]
    squares = sum(float((ratio[feature[i:j]] ** 2).sum()) for _, _, i, j in blocks)
    scale = max(float(np.sqrt(squares / n)) if n else 1.0, 1e-9)
    value = ratio / scale
    beta, bias = np.zeros(k), 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, effect = np.zeros(k), 0.0, beta * value
        for lo, hi, i, j in blocks:
            row = np.repeat(np.arange(hi - lo), size[lo:hi])
            z = np.bincount(row, effect[feature[i:j]], hi - lo) + bias
            r = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[lo:hi])
            g += np.bincount(feature[i:j], r[row], k)
            gb += r.sum()
        g = g * value + penalty * beta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        rate = 0.2 * (1 - t / (steps + 1))
        beta -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return beta / scale, float(bias)
