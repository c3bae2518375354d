"""Quality rules: an isolation forest on the statistics that text rules look at.

Each document is a row of rule statistics, counted over its whole text in Arrow batches. Trees of random splits, each over a
few documents, give each row a mean path length: rows that few splits set apart are anomalous. All labelled rows decide how
short a path is too short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.kernels import SPACE, Words, mix, pieces, shingle_hashes, utf8
from provena.session import written_table

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: What the forest looks at: shares and means, so that the length of a document is no anomaly by itself.
FEATURES = (
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "stop_share",
    "line_words", "distinct_share",
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def statistics(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of every text: one row each, columns as in ``STATS`` and ``FEATURES``; a null is an empty text."""
    data, offsets = utf8(column)
    counts, features = [np.zeros((0, len(STATS)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for i, j in pieces(offsets):
        c, f = _piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        counts.append(c)
        features.append(f)
    return np.concatenate(counts), np.concatenate(features)


def _piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    words = Words(data, offsets, lower=False)
    n = np.diff(words.first)
    blank = SPACE[data]
    chars = total(~blank & ((data & 0xC0) != 0x80))
    symbols = total(_IS_SYMBOL[data])
    # three-word windows found twice or more: every word that one of them covers, once
    covered = np.zeros(len(words.hash) + 3, np.int64)
    h, doc = shingle_hashes(words, 3)
    inside = n[doc] >= 3
    h, doc = h[inside], doc[inside]
    if len(h):
        at = words.first[doc] + _within(doc)
        by = np.lexsort((h, doc))
        same = (h[by][1:] == h[by][:-1]) & (doc[by][1:] == doc[by][:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = at[by[twice]]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + 3, -1)
    repeated = np.cumsum(covered)[: len(words.hash)] > 0
    n_repeat = np.bincount(words.doc, repeated, rows).astype(np.int64)
    # lines of one text: whole runs between line feeds that hold a word
    lines = Words(data, offsets, _LINE, lower=False)
    upto = np.concatenate([[0], np.cumsum(~blank, dtype=np.int64)])
    real = upto[lines.end] > upto[lines.start]
    lh, ld = lines.hash[real], lines.doc[real]
    n_lines = np.bincount(ld, minlength=rows)
    n_dup = n_lines - _distinct(lh, ld, rows)
    distinct = _distinct(words.hash, words.doc, rows)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return x / np.maximum(of, 1)

    counts = np.stack([n, chars, symbols, n_dup, n_repeat], axis=1)
    features = np.stack(
        [
            np.log1p(share(chars, n)), share(symbols, chars), share(n_dup, n_lines), share(n_repeat, n), share(total(_UPPER[data]), chars),
            share(total(_DIGIT[data]), chars), share(total(_MARK[data]), chars), share(total(_STOP[data]), n),
            np.log1p(share(n, n_lines)), np.where(n > 0, np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9), 1.0),
        ],
        axis=1,
    )
    return counts, features


def _within(doc: np.ndarray) -> np.ndarray:
    """Position of every row inside its run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))


def _distinct(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    by = np.lexsort((h, doc))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    return np.bincount(doc[by][new], minlength=rows)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree over ``n`` rows, which stands for the splits a leaf spares."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``value``, ``left`` child (the right one follows it), ``path`` at leaves."""

    feature: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    left: np.ndarray = field(repr=False)
    path: np.ndarray = field(repr=False)
    roots: np.ndarray = field(repr=False)
    rows: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path) of every row, between 0 and 1; higher is more anomalous. Without trees 0."""
        if len(self.roots) == 0:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            live = every
            while len(live):
                f = self.feature[node[live]]
                live = live[f >= 0]
                f, at = f[f >= 0], node[live]
                node[live] = self.left[at] + (x[live, f] >= self.value[at])
            total += self.path[node]
        return 2.0 ** -(total / len(self.roots) / max(float(expected_path(self.rows)), 1e-9))


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, rows: int, depth: int, seed: int) -> IsolationForest:
    """``trees`` trees over ``rows`` rows of ``x`` each, drawn without repetition: a random feature, then a random value of its side of the box.

    The box starts at ``low`` to ``high``, the range of all examples, and is cut by every split. A statistic that does not
    vary among ``x`` splits too, so a text that differs in it lands in an empty box after few splits.
    """
    rng = np.random.default_rng(seed)
    feature, value, left, path, roots = [], [], [], [], []
    size = min(rows, len(x))

    def add() -> int:
        for part, empty in ((feature, -1), (value, 0.0), (left, -1), (path, 0.0)):
            part.append(empty)
        return len(feature) - 1

    for _ in range(trees if size else 0):
        roots.append(add())
        todo = [(roots[-1], rng.choice(len(x), size, replace=False), low, high, 0)]
        while todo:
            node, part, lo, hi, at = todo.pop()
            able = np.flatnonzero(hi > lo)
            if at >= depth or len(part) <= 1 or len(able) == 0:
                path[node] = at + float(expected_path(len(part)))
                continue
            f = int(rng.choice(able))
            feature[node], value[node] = f, hi[f] - rng.random() * (hi[f] - lo[f])
            right = x[part, f] >= value[node]
            left[node] = add()
            add()
            inner, outer = lo.copy(), hi.copy()
            inner[f] = outer[f] = value[node]
            todo += [(left[node], part[~right], lo, outer, at + 1), (left[node] + 1, part[right], inner, hi, at + 1)]
    return IsolationForest(np.array(feature, np.int64), np.array(value, float), np.array(left, np.int64), np.array(path, float), np.array(roots, np.int64), size)


@dataclass(frozen=True)
class QualityRules:
    """A forest and the score from which a document is an anomaly."""

    forest: IsolationForest
    threshold: float

    def judge(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, anomaly, typical) of every row of ``docs``.

        ``typical`` is true where the score is below the threshold. Every whole text is read; a null text is an empty one,
        all of whose statistics are 0. Rows with equal texts get equal results, and repeated or null keys stay rows of
        their own. Other columns are not read, whatever their names. Equality of lines, words and windows inside a text is
        that of 64-bit hashes.
        """
        f = self.forest
        model = docs.sparkSession.sparkContext.broadcast((f.feature, f.value, f.left, f.path, f.roots, f.rows))
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = IsolationForest(*model.value)
            for batch in batches:
                counts, features = statistics(batch.column(1))
                score = forest.score(features)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(score), pa.array(score < threshold)],
                    names=["key", *STATS, "anomaly", "typical"],
                )

        fields = [T.StructField("key", docs.schema[key].dataType), *(T.StructField(s, T.LongType()) for s in STATS)]
        schema = T.StructType([*fields, T.StructField("anomaly", T.DoubleType()), T.StructField("typical", T.BooleanType())])
        return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    """The fixed rules: fewer than 50 words, or more than half of the words inside repeated windows."""
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat_words) > 50 * F.col(n_words))


def features_of(docs: DataFrame) -> DataFrame:
    """(k, x) of every row (k, text) that the fixed rules do not reject: ten numbers a row, counted where the text is read."""
    schema = T.StructType([docs.schema["k"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = statistics(batch.column(1))
            use = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(use)), pa.array(list(x[use]), pa.list_(pa.float64()))], names=["k", "x"])

    return docs.select("k", "text").mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def order_statistic(values: DataFrame, column: str, at: int) -> float:
    """Value number ``at`` (from 0, ascending) of a column of doubles that are not negative.

    Such doubles are ordered as their bits are. They are counted by leading bits, sixteen more in each round, so that at most
    65,536 counts reach the driver.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.int64))], names=["b"])

    rows, known = written_table(values.select(column).mapInArrow(bits, "b long")), 0
    for shift in (48, 32, 16, 0):
        counts = rows.groupBy(F.shiftright("b", shift).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
        for known, n in sorted(tuple(r) for r in counts):
            if at < n:
                break
            at -= n
        rows = rows.where(F.shiftright("b", shift) == known)
    return float(np.array(known, np.int64).view(np.float64))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = 8_000,
    trees: int = 100,
    tree_rows: int = 256,
    depth: int = 8,
    loss: float = 0.003,
    seed: int = 0,
) -> QualityRules:
    """Grow a forest and calibrate its threshold on all labelled documents.

    Rows that the fixed rules reject teach nothing. The box that all labelled rows span (``label`` 1 good, 0 bad) bounds the
    trees, so that a path says how far a text is from the good ones. A tree of an isolation forest sees ``tree_rows`` rows; they
    are drawn from ``rows`` good ones chosen by a hash of the key. The threshold lies above all but the share ``loss`` of all
    good rows. A key labelled more than once counts as bad if any row says so; null keys and labels are no examples. Without good
    examples nothing is an anomaly.
    """
    given = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    given = given.groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    # The text stays where it is read; ten numbers a row meet the labels.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where("k is not null")
    rated = written_table(features_of(texts).join(given, "k").dropDuplicates(["k"]))
    ends = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n_good, *box = rated.agg(F.count_if(F.col("y") == 1), *ends).first()
    if n_good == 0:
        none = np.zeros((0, len(FEATURES)))
        return QualityRules(grow(none, none, none, 0, 0, 0, seed), np.inf)
    good = rated.where("y = 1")
    drawn = good.orderBy(F.xxhash64(F.lit("forest"), "k"), "k").limit(rows).select("k", "x").toArrow().sort_by("k")
    low, high = np.array(box, float).reshape(2, -1)
    forest = grow(matrix(drawn.column("x").combine_chunks()), low, high, trees, tree_rows, depth, seed)
    model = docs.sparkSession.sparkContext.broadcast((forest.feature, forest.value, forest.left, forest.path, forest.roots, forest.rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = IsolationForest(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(own.score(matrix(batch.column(0))))], names=["score"])

    least = order_statistic(good.select("x").mapInArrow(score, "score double"), "score", int((1 - loss) * (n_good - 1)))
    return QualityRules(forest, float(np.nextafter(least, 2.0)))
