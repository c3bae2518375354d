"""Benchmark decontamination by latent semantic retrieval: candidates by cosine in an SVD space, then word sequences.

1. Terms are the words of the benchmark items. They are weighed by the number of different contexts (the words on both
   sides) that the whole corpus has them in, so that a passage which a third of all documents copy does not make its words
   common.
2. A randomised SVD of TF-IDF passages: each task multiplies the passages it reads with a random matrix and back with their
   transpose, and the partial products are added up. The items count as passages with ``item_weight`` times the energy of the
   corpus, so that the space keeps what tells items apart. The driver sees only the terms x rank product.
3. Documents are read in overlapping windows. The ladder of window lengths follows the items: an item always lies whole in
   some window of which it is more than a half. A window whose terms carry too little of its TF-IDF mass cannot reach the
   least cosine and is passed over, and so is, for one item, a window that holds too few words of the item for the overlap, in
   any order; that loses nothing. All others are compared with the item in the latent space.
4. A candidate is contamination if enough of the item stands in the window in order (longest common subsequence) and if its
   answer, the end of the item or a column of its own, does too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provena.functions.ranking import union_all
from provena.llm.kernels import PUNCT, U64, Words, mix, pieces, signed, utf8
from provena.session import discard, written_table


#: Window lengths in words, each about the square root of two times the one before.
LADDER = [int(8 * 2 ** (k / 2)) for k in range(40)]


@dataclass(frozen=True)
class Decontamination:
    """min_cosine: of candidates. min_overlap, min_answer: shares of the item's and of the answer's words found in order.

    max_items: of one call of the search. The space has a fixed rank and must hold the items of its call; more are cut into calls.
    max_terms: more distinct words are hashed to so many terms. rank: of the latent space. common: terms with more
    contexts than this share of the documents, and than 50, tell nothing and are left out. answer_words: length of the answer where none is given.
    """

    min_cosine: float = 0.25
    min_overlap: float = 0.6
    min_answer: float = 0.5
    max_items: int = 200
    max_terms: int = 8192
    rank: int = 256
    common: float = 0.1
    answer_words: int = 5
    item_weight: float = 8.0
    seed: int = 1

    def matches(
        self, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
        item_text: str = "text", answer: str | None = None,
    ) -> DataFrame:
        """(key, item_id, cosine, overlap) of every document and item that it holds, at its best window.

        Items travel whole to every task: a benchmark is small beside a corpus. More than ``max_items`` are gone through in
        equal parts, each with a vocabulary, weights and a space of its own and its passes over the text. Items without words match nothing; null texts are empty. Rows that repeat a key count by row.
        """
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        kept = items.select(F.col(item).alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None)).alias("a"))
        kind, item_kind = docs.schema["key"].dataType.simpleString(), kept.schema["i"].dataType.simpleString()
        schema = f"key {kind}, item_id {item_kind}, cosine double, overlap double"
        rows = [r for r in [(r["i"], r["t"] or "", r["a"]) for r in kept.collect()] if len(hashed(r[1]))]
        if not rows:
            return docs.sparkSession.createDataFrame([], schema)
        calls = -(-len(rows) // self.max_items)
        parts = [self._matches(docs, rows[k::calls], schema, to_arrow_type(kept.schema["i"].dataType)) for k in range(calls)]
        return union_all(parts)

    def _matches(self, docs: DataFrame, rows: list[tuple], schema: str, item_type: pa.DataType) -> DataFrame:
        bench = Bench.of(rows, self)
        spark = docs.sparkSession
        weights, rare = self._weights(docs, bench)
        latent = self._space(docs, bench, weights)
        items_latent = bench.matrix(weights) @ latent
        norms = np.sqrt((bench.matrix(weights) ** 2).sum(1))
        part = (latent * weights[:, None]) @ (items_latent / np.maximum(norms, 1e-12)[:, None]).T
        model = spark.sparkContext.broadcast((
            bench.vocabulary, bench.term, weights.astype(np.float32), float(rare), part.astype(np.float32),
            bench.matrix(np.ones(bench.terms)) > 0, bench.scale, bench.sequences, bench.answers,
        ))
        names, options = bench.items, (self.min_cosine, self.min_overlap, self.min_answer)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                rows: list[tuple[int, int, float, float]] = []
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PUNCT)
                    rows += [(a + d, *rest) for d, *rest in search(words, *model.value, *options, known)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([names[r[1]] for r in rows], item_type),
                     pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())],
                    names=["key", "item_id", "cosine", "overlap"],
                )

        return docs.mapInArrow(found, schema)

    def _weights(self, docs: DataFrame, bench: "Bench") -> tuple[np.ndarray, float]:
        """Inverse context frequency of each term, 0 if common, and the one that stands for words outside the benchmark.

        A context counts once in the whole corpus: each task hands on its distinct pairs of term and context, 24 and 40 bits
        of one number, and they are made distinct again before they are counted.
        """
        shared = docs.sparkSession.sparkContext.broadcast((bench.vocabulary, bench.term))
        terms, low = bench.terms, 0xFFFFFF

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, term = shared.value
            held, n = [np.zeros(0, U64)], 0
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PUNCT)
                    at, t = lookup(words.hash, vocabulary, term)
                    # nothing stands before the first word of a document or after its last
                    begin, end = words.first[words.doc[at]], words.first[words.doc[at] + 1]
                    before = np.where(at > begin, np.append(U64(0), words.hash)[at], U64(0))
                    after = np.where(at + 1 < end, np.append(words.hash, U64(0))[at + 1], U64(0))
                    around = mix(mix(before) + U64(3) * mix(after + U64(1)))
                    held.append((around & ~U64(low)) | t.astype(U64))
                    if sum(map(len, held)) > 1_000_000:
                        held = [distinct(np.concatenate(held))]
                        if len(held[0]) > 500_000:
                            yield pairs(held[0], 1)
                            held = [np.zeros(0, U64)]
                n += batch.num_rows
            yield pairs(distinct(np.concatenate(held)), 1)
            yield pairs(np.array([-1]), n)

        def pairs(p: np.ndarray, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(p)), pa.array(np.full(len(p), n, np.int64))], names=["p", "n"])

        made = docs.select("text").mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
        one = F.when(F.col("p") == -1, F.col("n")).otherwise(1)  # the row of -1 counts documents
        # written, so that the contexts that were shuffled are gone before the next pass
        tallied = written_table(made.groupBy(F.col("p").bitwiseAND(low).alias("t")).agg(F.sum(one).alias("n")))
        counts = tallied.toPandas()
        discard(tallied)
        counts["t"] = counts["t"].where(counts["t"] != low, terms)
        df = np.zeros(terms + 1)
        df[counts["t"]] = counts["n"]
        idf = np.log((1 + df[terms]) / (1 + df[:terms]))
        idf = np.maximum(idf, 0.1)
        rare = float(np.median(idf)) if terms else 1.0
        return np.where(df[:terms] > max(self.common * df[terms], 50), 0.0, idf), rare

    def _space(self, docs: DataFrame, bench: Bench, weights: np.ndarray) -> np.ndarray:
        """terms x rank: an orthonormal basis of the leading right singular space of passages and items.

        A passage holds few of the terms, so a task counts the pairs of terms that its passages hold and multiplies the counts
        once, at its end: terms x terms numbers of four bytes.
        """
        terms = bench.terms
        rank = min(self.rank, terms)
        omega = np.random.default_rng(self.seed).normal(size=(terms, min(rank + 8, terms))).astype(np.float32)
        shared = docs.sparkSession.sparkContext.broadcast((bench.vocabulary, bench.term, weights.astype(np.float32), omega))
        step, blocks = 64, 256
        cuts = np.linspace(0, terms, blocks + 1).astype(int)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, term, weight, omega = shared.value
            together, alone = np.zeros((terms, terms), np.int32), np.zeros(terms, np.int64)
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PUNCT)
                    at, t = lookup(words.hash, vocabulary, term)
                    heavy = weight[t] > 0
                    at, t = at[heavy], t[heavy]
                    # a passage is a stretch of 64 words of one document
                    passage = (at - words.first[words.doc[at]]) // step + words.doc[at] * (1 << 32)
                    alone += np.bincount(t, minlength=terms)
                    count_pairs(together, t, passage)
            scaled, w = omega * weight[:, None], weight.astype(np.float64)
            energy = float((alone * w**2).sum())
            out = np.zeros((terms, omega.shape[1]))
            for i in range(0, terms, 512):
                rows = together[i : i + 512] + together[:, i : i + 512].T
                out[i : i + 512] = rows.astype(np.float32) @ scaled
            out = (out + alone[:, None] * scaled) * w[:, None]
            out = out.astype(np.float32)  # a task's sum travels in half the bytes; sums over tasks are taken in double
            parts = [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)] + [np.array([energy], np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

        def total(rows: pd.DataFrame) -> pd.DataFrame:
            s = np.sum([np.frombuffer(p, np.float32) for p in rows["part"]], axis=0, dtype=np.float64).astype(np.float32)
            return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [s.tobytes()]})

        # added up in two steps, in many small blocks, so that a group stays small however many tasks there are
        made = docs.select("text").mapInArrow(product, "block int, part binary").withColumn("s", F.pmod(F.spark_partition_id(), F.lit(8)))
        made = made.groupBy("block", "s").applyInPandas(total, "block int, part binary").groupBy("block").applyInPandas(total, "block int, part binary")
        summed = written_table(made)
        parts = {r["block"]: np.frombuffer(r["part"], np.float32).astype(np.float64) for r in summed.collect()}
        discard(summed)
        energy = float(parts.pop(blocks, np.zeros(1))[0])
        corpus = np.concatenate([parts[i] for i in range(blocks)]).reshape(terms, -1) if parts else np.zeros((terms, omega.shape[1]))
        q = bench.matrix(weights)
        scale = self.item_weight * energy / max(float((q * q).sum()), 1e-12) if energy else 1.0
        basis, _ = np.linalg.qr(corpus + scale * (q.T @ (q @ omega)))
        return basis[:, :rank]


@dataclass(frozen=True)
class Bench:
    """Items as word hashes. vocabulary: sorted hashes, term: their terms; scale: length of the windows each item is looked for in."""

    items: list
    sequences: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    term: np.ndarray
    terms: int
    scale: np.ndarray

    @staticmethod
    def of(rows: list[tuple], options: Decontamination) -> Bench:
        items, sequences, answers = [], [], []
        for name, text, answer in rows:
            words = hashed(text)
            if len(words):
                items.append(name)
                sequences.append(words)
                answers.append(hashed(answer) if answer else words[-options.answer_words :])
        vocabulary = np.unique(np.concatenate([np.zeros(0, U64), *sequences]))
        terms = min(len(vocabulary), options.max_terms)
        term = np.arange(len(vocabulary)) if terms == len(vocabulary) else (mix(vocabulary) % U64(terms)).astype(np.int64)
        # the shortest window of the ladder that holds an item of n words whole wherever it begins within a hop, an eighth
        scale = np.array([next(x for x in LADDER if x - x // 8 >= len(s)) for s in sequences], np.int64)
        return Bench(items, sequences, answers, vocabulary, term, terms, scale)

    def matrix(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.items), self.terms))
        for i, s in enumerate(self.sequences):
            np.add.at(out[i], self.term[np.searchsorted(self.vocabulary, s)], 1.0)
        return out * weights


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return Words(raw, np.array([0, len(raw)]), PUNCT).hash


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def lookup(h: np.ndarray, vocabulary: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, terms) of the words that belong to the vocabulary."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # words are found by the first 16 bits of their hash; those of the vocabulary that share them stand side by side
    cuts = np.searchsorted(vocabulary, np.arange(1 << 16).astype(U64) << U64(48))
    size = np.diff(np.append(cuts, len(vocabulary)))
    head = (h >> U64(48)).astype(np.uint16)
    place, hit = np.full(len(h), -1, np.int32), np.flatnonzero((size > 0)[head])
    for k in range(int(size.max())):
        if k:
            hit = hit[size[head[hit]] > k]
        there = cuts[head[hit]] + k
        same = vocabulary[there] == h[hit]
        place[hit[same]] = there[same]
    at = np.flatnonzero(place >= 0)
    return at, term[place[at]]


def count_pairs(together: np.ndarray, t: np.ndarray, passage: np.ndarray) -> None:
    """Adds to ``together`` the pairs of different places of a passage, by their terms, the earlier place first."""
    flat, width = together.reshape(-1), together.shape[1]
    row = t * width
    first = np.arange(len(t))
    for lag in range(1, len(t)):
        first = first[: np.searchsorted(first, len(t) - lag)]
        first = first[passage[first] == passage[first + lag]]  # places of a passage stand side by side
        if not len(first):
            break
        np.add.at(flat, row[first] + t[first + lag], np.ones(len(first), flat.dtype))


def search(
    words: Words, vocabulary: np.ndarray, term: np.ndarray, weight: np.ndarray, rare: float, part: np.ndarray, member: np.ndarray,
    scale: np.ndarray, sequences: list[np.ndarray], answers: list[np.ndarray], min_cosine: float, min_overlap: float, min_answer: float,
    known: dict,
) -> Iterator[tuple[int, int, float, float]]:
    """(doc, item, cosine, overlap) of what is found in some documents, each pair once, at the window with the highest overlap.

    part: terms x items, what a term adds to the cosine before the window's norm. member: items x terms, which hold which.
    """
    n = len(words.hash)
    every, t_every = lookup(words.hash, vocabulary, term)
    mass = np.full(n, rare * rare)
    mass[every] = weight[t_every] ** 2
    total = np.concatenate([[0.0], np.cumsum(mass)])
    mine = np.zeros(n)
    mine[every] = weight[t_every] ** 2
    inside = np.concatenate([[0.0], np.cumsum(mine)])
    heavy = weight[t_every] > 0
    at, t = every[heavy], t_every[heavy]
    below, below_every = (np.append(0, np.cumsum(np.bincount(x, minlength=n))) for x in (at, every))
    best: dict[tuple[int, int], tuple[float, float]] = {}  # (overlap, cosine)
    place = every.astype(np.int32)
    found = [held_enough(words, place, member[i].take(t_every), int(scale[i]), min_overlap * len(s)) for i, s in enumerate(sequences)]
    item, starts = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])
    hop, doc = np.maximum(scale[item] // 8, 1), words.doc[starts]
    ends = np.minimum(starts + scale[item], words.first[doc + 1])
    norm = total[ends] - total[starts]
    lo, hi = below[starts], below[ends]
    some = np.flatnonzero((hi > lo) & (inside[ends] - inside[starts] >= min_cosine**2 * np.maximum(norm, 1e-12) * (1 - 1e-9)))
    cosine = np.zeros(len(starts))
    # windows of about a million terms at a time
    size = np.cumsum(hi[some] - lo[some])
    for few in np.split(some, np.flatnonzero(np.diff(size >> 20)) + 1):
        of, place = ranges(lo[few], hi[few])
        cosine[few] = np.bincount(of, part[t[place], item[few][of]], len(few)) / np.maximum(np.sqrt(norm[few]), 1e-12)
    some = some[cosine[some] >= min_cosine]
    # the sequences are compared two hops beyond the window
    left, right = np.maximum(starts - 2 * hop, words.first[doc]), np.minimum(ends + 2 * hop, words.first[doc + 1])
    for r in some.tolist():
        i, d, score = int(item[r]), int(doc[r]), float(cosine[r])
        so_far = best.get((d, i), (0.0, 0.0))
        if so_far >= (1.0, score):
            continue
        # only words of the item count for its sequence
        around = slice(below_every[left[r]], below_every[right[r]])
        inner = every[around][member[i, t_every[around]]]
        if len(inner) < min_overlap * len(sequences[i]):
            continue
        share = remembered(known, i, words.hash[inner], lambda w: common_subsequence(sequences[i], w) / len(sequences[i]))
        if share < min_overlap or (share, score) <= so_far:
            continue
        answered = remembered(known, ~i, words.hash[left[r] : right[r]], lambda w: common_subsequence(answers[i], w) >= min_answer * len(answers[i]))
        if share > 0 and answered:
            best[d, i] = (share, score)
    for (d, i), (share, cosine) in best.items():
        yield d, i, cosine, share


def remembered(known: dict, name: int, window: np.ndarray, value: Callable[[np.ndarray], float]) -> float:
    """``value`` of a window, from ``known`` if it was asked for before under this name."""
    key = (name, window.tobytes())
    if key not in known:
        if len(known) > 20_000:
            known.clear()
        known[key] = value(window)
    return known[key]


def held_enough(words: Words, every: np.ndarray, mine: np.ndarray, length: int, need: float) -> np.ndarray:
    """Starts of the windows, and none but a few others, that hold ``need`` words of an item, with two hops on either side.

    every: places of the words that any item holds; mine: which of these the item holds. Windows begin at every hop of a document.
    """
    hop, least = max(length // 8, 1), max(int(np.ceil(need - 1e-9)), 1)
    place = every.take(np.flatnonzero(mine))
    close = np.flatnonzero(place[least - 1 :] - place[: max(len(place) - least + 1, 0)] < length + 4 * hop)
    if not len(close):
        return close
    first, last = place[close].astype(np.int64), place[close + least - 1].astype(np.int64)
    together = words.doc[first] == words.doc[last]
    first, last = first[together], last[together]
    begin = words.first[words.doc[first]]
    # a start lies two hops behind the first word at most, and so far before the last one that the window reaches it
    lo = -(-np.maximum(last - length - 2 * hop + 1 - begin, 0) // hop)
    hi = (np.minimum(first + 2 * hop, words.first[words.doc[first] + 1] - 1) - begin) // hop
    of, k = ranges(lo, np.maximum(hi + 1, lo))
    return distinct(begin[of] + k * hop)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all whole numbers from ``lo`` up to ``hi``, which is left out, of each row."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(lo - np.append(0, np.cumsum(n)[:-1])[: len(n)], n)


def common_subsequence(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, all of one sequence in the bits of an integer."""
    masks: dict[int, int] = {}
    for k, h in enumerate(one.tolist()):
        masks[h] = masks.get(h, 0) | 1 << k
    full = (1 << len(one)) - 1
    v = full
    for h in two.tolist():
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(one) - v.bit_count()
