"""Phrase collocations: best-first growth of phrases from their prefixes, with score bounds from prefix counts.

The corpus is turned into word numbers once, as a written table of blocks. Words and pairs are counted in full; longer
phrases only under the prefixes whose bound reaches the score that the last phrase of its language's list has so
far. A round expands the best open prefixes of every language in one pass over the blocks, and the search ends when no
open prefix can reach its list any more.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.ranking import top_k
from provena.llm.kernels import LOWER, U64, Words, mix, pieces, signed, utf8
from provena.session import shared_folder, written_table

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _SEPARATES.copy()
_BREAKS[[0x20, 0x09]] = True
#: Bytes of text in a block of word numbers.
BLOCK_BYTES = 1 << 19
#: Blocks of a row group of their table: a row is large, and row groups are what tasks share out.
GROUP_BLOCKS = 8
#: Texts looked at together: a batch of Arrow is cut into slices of so many.
SLICE_ROWS = 1000

BLOCKS = "lang string, ids array<long>, words array<string>, counts array<long>, codes array<int>"
NODE = ["i1", "i2", "i3"]
#: In place of the third word of a pair.
NONE = 0


def encoded(docs: DataFrame, lang: str, text: str, salt: int = 0) -> DataFrame:
    """Blocks of texts of one language: its distinct words (``ids``, ``words``, ``counts``) and ``codes``, the words in order.

    A code is the place of a word in ``ids`` from 1; 0 stands between pieces. ``ids`` are hashes of language and word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            langs = batch.column(0).to_pylist()
            for name in dict.fromkeys(langs):
                at = pa.array([i for i, x in enumerate(langs) if x == name], pa.int64())
                data, offsets = utf8(batch.column(1).take(at))
                for i, j in pieces(offsets, BLOCK_BYTES):
                    block = _block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], name, salt)
                    if block is not None:
                        yield block

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text)).mapInArrow(run, BLOCKS)


def _block(data: np.ndarray, offsets: np.ndarray, lang: str, salt: int) -> pa.RecordBatch | None:
    low = LOWER[data]
    words = Words(_salted(salt)[low], offsets, _BREAKS, lower=False)
    if len(words.hash) == 0:
        return None
    own = np.array([int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")], U64)
    ids, first, code, count = np.unique(words.hash ^ own, return_index=True, return_inverse=True, return_counts=True)
    parts = np.concatenate([[0], np.cumsum(_SEPARATES[data])])
    fresh = np.ones(len(code), bool)
    fresh[1:] = (words.doc[1:] != words.doc[:-1]) | (parts[words.start[1:]] > parts[words.end[:-1]])
    codes = np.zeros(len(code) + int(fresh.sum()), np.int32)
    codes[np.arange(len(code)) + np.cumsum(fresh)] = code + 1
    raw = low.tobytes()
    names = [raw[s:e].decode("utf-8", "replace") for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang]), pa.array([signed(mix(ids))], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.string())),
            pa.array([count], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.int32())),
        ],
        names=["lang", "ids", "words", "counts", "codes"],
    )


def staged(blocks: DataFrame) -> DataFrame:
    """``blocks`` as a written table of small row groups."""
    path = f"{shared_folder(blocks.sparkSession)}/tables/{uuid.uuid4().hex}"
    groups = {"parquet.block.row.count.limit": GROUP_BLOCKS, "parquet.page.size.row.check.min": 1, "compression": "zstd"}
    blocks.write.options(**groups).parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS).parquet(path)


def _salted(salt: int) -> np.ndarray:
    """A permutation of the bytes of words: another one gives other hashes."""
    table = np.arange(256, dtype=np.uint8)
    if salt:
        inside = np.flatnonzero(~_BREAKS)
        table[inside] = np.random.default_rng(salt).permutation(inside)
    return table


class Bitmap:
    """Which numbers may belong to a set: ``1 << bits`` bits whatever its size, so a broadcast of fixed length. Others pass too if their bit is set."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, ids: DataFrame, column: str, bits: int) -> Bitmap:
        shift, slices = 64 - bits, 32
        place = F.shiftrightunsigned(F.col(column), shift)
        span = (1 << bits) // slices

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                at = b.column(0).to_numpy()
                for s in np.unique(at // span):
                    bit = at[at // span == s] - s * span
                    np.bitwise_or.at(held.setdefault(int(s), np.zeros(span // 8, np.uint8)), bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["s", "b"])

        # one row per slice of the bitmap reaches the driver
        rows = ids.select(place.alias("p")).distinct().repartition(slices, F.floor(F.col("p") / span)).mapInArrow(packed, "s long, b binary").collect()
        out = np.zeros((slices, span // 8), np.uint8)
        for r in rows:
            out[r["s"]] |= np.frombuffer(bytes(r["b"]), np.uint8)
        return cls(out.reshape(-1), bits)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        at = (ids.view(U64) >> U64(64 - self.bits)).astype(np.int64)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _flat(column: pa.Array) -> Iterator[np.ndarray]:
    for i in range(len(column)):
        yield column[i].values.to_numpy(zero_copy_only=False)


def names_of(blocks: DataFrame, frequent: Bitmap) -> DataFrame:
    """(id, lang, word) of the words that may be frequent, once a block."""
    model = blocks.sparkSession.sparkContext.broadcast((frequent.words, frequent.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(*model.value)
        for b in batches:
            for k, ids in enumerate(_flat(b.column("ids"))):
                keep = pa.array(np.flatnonzero(bitmap.may_hold(ids)))
                lang = pa.array([b.column("lang")[k].as_py()] * len(keep), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(keep), lang, b.column("words")[k].values.take(keep)], names=["id", "lang", "word"])

    return blocks.select("lang", "ids", "words").mapInArrow(run, "id long, lang string, word string")


def pair_counts(blocks: DataFrame, frequent: Bitmap, part: int = 0, parts: int = 1) -> DataFrame:
    """(i1, i2, c) of the pairs of words that may be frequent, summed by block; of one of ``parts`` parts by the words' hashes."""
    model = blocks.sparkSession.sparkContext.broadcast((frequent.words, frequent.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(*model.value)
        for b in batches:
            for ids, codes in zip(_flat(b.column("ids")), _flat(b.column("codes")), strict=True):
                use = np.concatenate([[False], bitmap.may_hold(ids)])[codes]
                own = np.concatenate([[0], ids])[codes]
                both = np.flatnonzero(use[:-1] & use[1:] & ((own[:-1] ^ own[1:]) % parts == part))
                key = (codes[both].astype(np.int64) - 1) * len(ids) + codes[both + 1] - 1
                key, count = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[key // len(ids)]), pa.array(ids[key % len(ids)]), pa.array(count)], names=["i1", "i2", "c"])

    return blocks.select("ids", "codes").mapInArrow(run, "i1 long, i2 long, c long")


@dataclass
class Matcher:
    """Finds phrases of two and three words in a block: exact, by places in sorted lists."""

    nodes: np.ndarray  # ids, one row per phrase, NONE as the third of a pair

    def __post_init__(self):
        n = self.nodes
        self.is_pair = n[:, 2] == NONE
        self.words = np.unique(np.concatenate([n[:, 0], n[:, 1], n[~self.is_pair, 2]]))
        w = np.searchsorted(self.words, n)
        size = len(self.words) + 1
        key = w[:, 0] * size + w[:, 1]
        self.pairs = np.unique(key)
        self.node_of_pair = np.full(len(self.pairs), -1)
        self.node_of_pair[np.searchsorted(self.pairs, key[self.is_pair])] = np.flatnonzero(self.is_pair)
        triple = np.searchsorted(self.pairs, key[~self.is_pair]) * size + w[~self.is_pair, 2]
        order = np.argsort(triple)
        self.triples, self.node_of_triple = triple[order], np.flatnonzero(~self.is_pair)[order]

    def find(self, ids: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(node, place, words) of every occurrence."""
        size = len(self.words) + 1
        w = self._place(self.words, ids)
        w = np.concatenate([[-1], w])[codes]
        t = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        p = self._place(self.pairs, w[t] * size + w[t + 1])
        t, p = t[p >= 0], p[p >= 0]
        node = self.node_of_pair[p]
        yield node[node >= 0], t[node >= 0], 2
        third = np.append(w, -1)[t + 2]
        t, p, third = t[third >= 0], p[third >= 0], third[third >= 0]
        k = self._place(self.triples, p * size + third)
        yield self.node_of_triple[k[k >= 0]], t[k >= 0], 3

    @staticmethod
    def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if len(known) == 0:
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, at, -1)


def extensions(blocks: DataFrame, nodes: np.ndarray, both: np.ndarray, frequent: Bitmap) -> DataFrame:
    """(node, side, next, c): how often phrase number ``node`` stands (side 0), after it which word (1) and, where ``both``, before it (-1)."""
    model = blocks.sparkSession.sparkContext.broadcast((nodes, both, frequent.words, frequent.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, both, bitmap = Matcher(model.value[0]), model.value[1], Bitmap(*model.value[2:])
        for b in batches:
            for ids, codes in zip(_flat(b.column("ids")), _flat(b.column("codes")), strict=True):
                use = np.concatenate([[False], bitmap.may_hold(ids)])
                padded = np.concatenate([codes, [0]]).astype(np.int64)
                width = len(ids) + 1
                keys = []
                for node, t, k in matcher.find(ids, codes):
                    keys.append(node * 3 * width)
                    for side, near in ((1, padded[t + k]), (2, padded[t - 1])):
                        ok = use[near] if side == 1 else use[near] & both[node]
                        keys.append((node[ok] * 3 + side) * width + near[ok])
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                near = key % width
                side = np.array([0, 1, -1], np.int32)[key // width % 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key // (3 * width)), pa.array(side), pa.array(np.where(near > 0, ids[near - 1], NONE)), pa.array(count)],
                    names=["node", "side", "next", "c"],
                )

    return blocks.select("ids", "codes").mapInArrow(run, "node long, side int, next long, c long")


def score(a: str | Column, total: Column) -> Column:
    """floor(2000000 * a / total), exact beyond 64 bits."""
    a = F.col(a) if isinstance(a, str) else a
    # 2000000 * a is exact as a decimal; ``div`` on decimals gives the whole part
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)"), total.cast("decimal(21,0)"))


def _sum(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("decimal(20,0)") + b.cast("decimal(20,0)")


def _cut(a: str, k: int, left: Column, right: Column) -> Column:
    return F.struct(score(a, _sum(left, right)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


@dataclass(frozen=True)
class Collocations:
    """The ``limit`` best phrases of two to four words of every language.

    ``least`` occurrences make a candidate; one inside a longer candidate with at least ``share`` percent of its
    occurrences is dropped. ``batch`` prefixes are expanded at a time, over all languages; more take more rounds. ``bits`` is the
    length of the bitmap of frequent words, in powers of two. Pairs are counted in ``parts`` parts, prefixes expanded in half as many, each
    a pass over the blocks: the disk holds the shuffle files of one part.
    """

    limit: int = 2000
    least: int = 30
    share: int = 80
    batch: int = 1 << 18
    bits: int = 24
    parts: int = 4

    def mine(self, docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score) of each language's first ``limit`` phrases; ties go by ``a``, then by phrase.

        A null language is ``und``, a null text empty; repeated rows count each; other columns are not read. Without candidates
        the result is empty.
        """
        for salt in range(8):
            blocks = staged(encoded(docs, lang, text, salt))
            counts = blocks.select("lang", F.explode(F.arrays_zip("ids", "counts")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.sum("x.counts").alias("f"))
            counts = written_table(counts.where(F.col("f") >= self.least))
            frequent = Bitmap.of(counts, "id", self.bits)
            own = names_of(blocks, frequent).groupBy("id").agg(
                F.min(F.struct("lang", "word")).alias("least"), F.max(F.struct("lang", "word")).alias("most")
            )
            words = written_table(counts.join(own, "id"))
            if words.where(F.col("least") != F.col("most")).isEmpty():
                break
        else:
            raise RuntimeError("two words with one hash under every salt")
        words = words.select("id", F.col("least.lang").alias("lang"), F.col("least.word").alias("word"), "f")
        n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        total = written_table(blocks.groupBy("lang").agg(F.sum(n).alias("n")))
        counted = reduce(DataFrame.unionAll, [
            written_table(pair_counts(blocks, frequent, k, self.parts).groupBy("i1", "i2").agg(F.sum("c").alias("f")).where(F.col("f") >= self.least))
            for k in range(self.parts)
        ])
        first = words.select(F.col("id").alias("i1"), "lang", F.col("f").alias("f1"))
        pairs = written_table(counted.join(first, "i1").join(words.select(F.col("id").alias("i2"), F.col("f").alias("f2")), "i2"))
        best, floor = self._grow(blocks, pairs, frequent, total.count())
        named = best.join(floor, "lang", "left").where(F.col("score") >= F.coalesce("floor", F.lit(0)))
        for i in ("i1", "i2", "i3", "i4"):
            named = named.join(words.select(F.col("id").alias(i), F.col("word").alias(f"w{i[1]}")), i, "left")
        named = named.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3", "w4")).join(total, "lang")
        ranked = top_k(named, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], self.limit)
        return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

    def _grow(self, blocks: DataFrame, pairs: DataFrame, frequent: Bitmap, langs: int) -> tuple[DataFrame, DataFrame]:
        """(the settled phrases that no longer one covers, the score that each language's list ends with)."""
        spark = blocks.sparkSession
        open_pairs = pairs.select("lang", "i1", "i2", F.lit(NONE).cast("long").alias("i3"), score("f", _sum("f1", "f")).alias("bound"), score("f", _sum("f1", "f2")).alias("own"))
        most = max(self.batch // max(langs, 1), 1)
        width = min(4 * self.limit, most)
        expanded: list[DataFrame] = []
        found: list[DataFrame] = []
        while True:
            if found:
                settled, more, floor = self._settled(pairs, reduce(DataFrame.unionAll, found), reduce(DataFrame.unionAll, expanded))
                nodes = open_pairs.unionAll(more).groupBy("lang", *NODE).agg(F.max("bound").alias("bound"), F.max("own").alias("own"))
                nodes = nodes.join(reduce(DataFrame.unionAll, expanded).select(*NODE), NODE, "left_anti")
                nodes = nodes.join(F.broadcast(floor) if langs <= 10_000 else floor, "lang", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0)))
            else:
                # to begin with, the pairs that score best themselves: they settle most of the list and so a high floor
                nodes = open_pairs.withColumn("floor", F.lit(0)).withColumn("bound", F.col("own"))
            # only a phrase that may be listed itself needs the words before it: they decide whether a longer one covers it
            both = F.coalesce(F.col("own") >= F.coalesce("floor", F.lit(0)), F.lit(True))
            front = top_k(nodes.select("lang", *NODE, "bound", both.alias("both")), ["lang"], [F.desc("bound"), *NODE], width).drop("rank", "bound")
            got = front.toArrow()  # at most ``batch`` rows
            if got.num_rows == 0:
                if not found:
                    floor = pairs.select("lang", F.lit(0).cast("long").alias("floor")).limit(0)
                    settled = pairs.select("lang", "i1", "i2", F.col("i1").alias("i3"), F.col("i1").alias("i4"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), F.col("f").alias("score")).limit(0)
                return settled, floor
            ids = np.stack([got.column(c).to_numpy() for c in NODE], axis=1)
            table = written_table(spark.createDataFrame(got.drop_columns("both").append_column("node", pa.array(np.arange(len(ids))))))
            both = got.column("both").to_numpy(zero_copy_only=False)
            parts = max(self.parts // 2, 1)
            for k in range(min(parts, len(ids))):
                grown = extensions(blocks, ids[k::parts], both[k::parts], frequent).groupBy("node", "side", "next").agg(F.sum("c").alias("c"))
                grown = grown.where(F.col("c") >= self.least).withColumn("node", F.col("node") * parts + k)
                found.append(written_table(table.join(grown, "node").drop("node")))
            expanded.append(table.drop("node"))
            width = min(8 * width, most)

    def _settled(self, pairs: DataFrame, found: DataFrame, expanded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What the counts of all rounds decide: settled phrases, open prefixes of three words with bounds, and each full list's last score."""
        two = F.col("i3") == NONE
        i1, i2, i3, nxt, c = (F.col(x) for x in ("i1", "i2", "i3", "next", "c"))

        def phrase(where: Column, *ids: Column) -> DataFrame:
            return found.where(where).select(*[x.alias(f"i{k + 1}") for k, x in enumerate(ids)], c.alias("a"))

        right, left, own = F.col("side") == 1, F.col("side") == -1, F.col("side") == 0
        head = pairs.select("lang", "i1", "i2", F.col("f").alias("f12"), "f1")
        triples = phrase(two & right, i1, i2, nxt).unionAll(phrase(two & left, nxt, i1, i2)).unionAll(phrase(~two & own, i1, i2, i3)).distinct()
        triples = triples.join(head, ["i1", "i2"]).join(
            pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("f").alias("f23"), F.col("f2").alias("f3")), ["i2", "i3"]
        )
        triples = written_table(triples)
        quads = phrase(~two & right, i1, i2, i3, nxt).unionAll(phrase(~two & left, nxt, i1, i2, i3)).distinct().join(head, ["i1", "i2"])
        quads = quads.join(pairs.select(F.col("i1").alias("i3"), F.col("i2").alias("i4"), F.col("f").alias("f34"), F.col("f2").alias("f4")), ["i3", "i4"])
        quads = quads.join(triples.select(*NODE, F.col("a").alias("f123")), NODE, "left").join(
            triples.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("i3").alias("i4"), F.col("a").alias("f234")), ["i2", "i3", "i4"], "left"
        )
        known = F.col("f123").isNotNull() & F.col("f234").isNotNull()
        a = F.col("a")
        # an unknown part stands at least as often as the whole, so its count may be put in for a bound
        cuts = [
            _cut("a", 1, F.col("f1"), F.coalesce("f234", a)), _cut("a", 2, F.col("f12"), F.col("f34")), _cut("a", 3, F.coalesce("f123", a), F.col("f4")),
        ]
        quads = written_table(quads.withColumn("cut", F.array_min(F.array(*cuts))).withColumn("known", known))
        triples = triples.withColumn("cut", F.array_min(F.array(_cut("a", 1, F.col("f1"), F.col("f23")), _cut("a", 2, F.col("f12"), F.col("f3")))))
        couples = pairs.withColumnRenamed("f", "a").withColumn("i3", F.lit(NONE).cast("long")).withColumn("cut", _cut("a", 1, F.col("f1"), F.col("f2")))
        none = F.lit(None).cast("long")
        longest = found.where(~own).groupBy(*NODE).agg(F.max("c").alias("longer"))
        short = couples.select("lang", *NODE, "a", "cut").unionAll(triples.select("lang", *NODE, "a", "cut"))
        short = short.join(expanded.select(*NODE).distinct(), NODE).join(longest, NODE, "left")
        covered = F.col("longer").cast("decimal(20,0)") * F.lit(100) >= a.cast("decimal(20,0)") * F.lit(self.share)
        short = short.where(~F.coalesce(covered, F.lit(False)))
        columns = ["lang", "i1", "i2", "i3", "i4", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")]
        settled = short.withColumn("i3", F.when(F.col("i3") != NONE, F.col("i3"))).withColumn("i4", none).select(*columns)
        settled = written_table(settled.unionAll(quads.where("known").select(*columns)))
        last = top_k(settled.select("lang", "score"), ["lang"], [F.desc("score")], self.limit)
        floor = written_table(last.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == self.limit).drop("n"))
        open_triples = triples.select("lang", *NODE, score("a", _sum("f1", "a")).alias("bound"), F.col("cut.score").alias("own"))
        asked = quads.where("not known")
        # their own scores are not known yet
        bound = [F.col("cut.score").alias("bound"), none.alias("own")]
        head_asked = asked.where("f123 is null").select("lang", *NODE, *bound)
        tail_asked = asked.where("f234 is null").select("lang", F.col("i2").alias("i1"), F.col("i3").alias("i2"), F.col("i4").alias("i3"), *bound)
        return settled, open_triples.unionAll(head_asked).unionAll(tail_asked), floor
