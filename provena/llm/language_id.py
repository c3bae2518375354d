"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in NumPy.

A text is the mean of the embeddings of its character n-grams; a linear layer and a softmax give each language's
probability. The logits are divided by a temperature fitted on examples the weights have not seen, and the same
examples give the confidence below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import bounded_sample, free
from provena.llm.kernels import char_grams, text_pieces

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``table[bucket]``: what an n-gram adds to each language's logit, that is, its embedding times the linear layer."""

    languages: list[str]
    table: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float
    threshold: float
    sizes: tuple[int, ...]
    bits: int

    def predict(self, docs: DataFrame, text: str = "text", lang: str = "lang_pred", score: str = "score", accepted: str = "accepted") -> DataFrame:
        """``docs`` with the likeliest language, its calibrated probability and whether that reaches the threshold.

        Every whole text is read. A null text or one without any letter is ``und`` with score 0 and not accepted,
        and so is every text if nothing was learned. Columns of the output names are replaced.
        """
        docs = docs.drop(lang, score, accepted)
        has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
        model = docs.sparkSession.sparkContext.broadcast(
            (self.table, self.bias, self.temperature, self.sizes, self.bits)
        )
        names, threshold = [*self.languages, UNKNOWN], self.threshold

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                p = probabilities(texts, *model.value)
                best = p.argmax(1) if p.shape[1] else np.full(len(texts), -1)
                value = np.where(letters & (best >= 0), p.max(1, initial=0.0), 0.0)
                chosen = pa.array(names).take(pa.array(np.where(letters, best, -1) % len(names)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], chosen, pa.array(value), pa.array((value >= threshold) & letters & (best >= 0))],
                    names=[*batch.schema.names[:-1], lang, score, accepted],
                )

        schema = T.StructType([
            *docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()),
            T.StructField(accepted, T.BooleanType()),
        ])
        return docs.withColumn(free(docs, "has_letter"), has_letter).mapInArrow(predicted, schema)


def probabilities(
    texts: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, sizes: tuple[int, ...], bits: int
) -> np.ndarray:
    out = [np.zeros((0, len(bias)))]
    for a, b in text_pieces(texts):
        total, count = np.zeros((b - a, len(bias))), np.zeros(b - a)
        for bucket, offsets in char_grams(texts[a:b], sizes, bits):
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            if len(some) and len(bias):
                total[some] += np.add.reduceat(table[bucket], offsets[:-1][some], axis=0)
            count += n
        out.append(softmax((total / np.maximum(count, 1)[:, None] + bias) / temperature))
    return np.concatenate(out)


def softmax(z: np.ndarray) -> np.ndarray:
    if z.shape[1] == 0:
        return z
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    rows: int = 1200,
    dims: int = 16,
    sizes: tuple[int, ...] = (1, 2, 3, 4),
    bits: int = 16,
    epochs: int = 8,
    rate: float = 0.5,
    target_error: float = 0.01,
    seed: int = 7,
) -> LanguageModel:
    """Learn from a bounded sample: about ``rows`` texts of each language at most; null languages and texts teach nothing.

    One example in five is kept back for the temperature and for the rejection threshold, the least confidence at
    which at most ``target_error`` of the accepted predictions are wrong.
    """
    given = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    given = given.select(F.col(lang).cast("string").alias("_y"), F.col(text).alias("_t"))
    sample, counts = bounded_sample(given, "_y", "_t", rows)
    names = sorted(counts)
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 1.0, sizes, bits)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, idx, cnt = batch.column(1).to_pylist(), [], []
            for a, b in text_pieces(ts):
                parts = [*char_grams(ts[a:b], sizes, bits)]
                for i in range(b - a):
                    u, n = np.unique(np.concatenate([x[o[i] : o[i + 1]] for x, o in parts]), return_counts=True)
                    idx.append(u.astype(np.int32).tobytes())
                    cnt.append((n / n.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary()),
                 pa.array([hash_of(t) for t in ts], pa.int64())], names=["y", "i", "c", "h"])

    # at most about rows x languages examples, each as its distinct n-grams
    known = sample.mapInArrow(grams, "y string, i binary, c binary, h long").toPandas().sort_values("h", kind="stable")
    index = [np.frombuffer(x, np.int32) for x in known["i"]]
    share = [np.frombuffer(x, np.float32) for x in known["c"]]
    y = known["y"].map({k: i for i, k in enumerate(names)}).to_numpy()
    held = np.arange(len(y)) % 5 == 4
    embed, layer, bias = sgd(index, share, y, np.flatnonzero(~held), len(names), dims, bits, epochs, rate, seed)
    table = (embed @ layer).astype(np.float32)
    tune = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.array([share[i] @ table[index[i]] for i in tune]) + bias
    temperature = min(
        np.geomspace(0.2, 20, 80),
        key=lambda t: -np.log(softmax(z / t)[np.arange(len(tune)), y[tune]] + 1e-12).mean(),
    )
    p = softmax(z / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    error = np.cumsum(p.argmax(1)[order] != y[tune][order]) / np.arange(1, len(tune) + 1)
    fine = np.flatnonzero(error <= target_error)
    threshold = float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0
    return LanguageModel(names, table, bias, float(temperature), threshold, sizes, bits)


def hash_of(text: str) -> int:
    """An order of the examples that depends on nothing but their text."""
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def sgd(
    index: list[np.ndarray], share: list[np.ndarray], y: np.ndarray, train_on: np.ndarray, classes: int, dims: int, bits: int,
    epochs: int, rate: float, seed: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent over single examples, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims))
    layer, bias = rng.normal(0, 0.1, (dims, classes)), np.zeros(classes)
    steps, done = epochs * len(train_on), 0
    for _ in range(epochs):
        for i in rng.permutation(train_on):
            at, w = index[i], share[i].astype(float)
            mean = w @ embed[at]
            z = mean @ layer + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            step = rate * (1 - done / steps)
            back = layer @ g
            layer -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            # the mean spreads a step thinly over the n-grams of a long text: scale it to the most frequent one
            embed[at] -= (step / w.max()) * w[:, None] * back
            done += 1
    return embed, layer, bias
