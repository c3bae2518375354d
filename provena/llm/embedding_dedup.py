"""Embedding near-dedup by a subspace pigeonhole join: links of unit vectors whose cosine reaches a threshold.

A cosine of t or more means a squared distance of 2 - 2t or less. Vectors are rotated by a fixed orthogonal matrix and cut
into blocks; the squared distances of the blocks add up to the whole, so in at least one block it is within the block's
share of the budget. Each block is joined by range: grid cells over its first coordinates, as wide as twice its radius, so
that every vector within reach lies in a cell that the vector visits. A pair is taken up only in the first block that holds
it within budget, and only where its smaller id is at home, so that every pair is verified once, in double precision.

A cell hands on no list of its pairs: degrees are summed by task, and links become a spanning forest. A cell that holds many
vectors is cut into parts, and pairs of parts are compared apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small
from provena.llm.common import components
from provena.llm.kernels import whole_runs
from provena.session import written_table


@dataclass(frozen=True)
class CosineLinks:
    """threshold: least cosine of a link. blocks: subspaces. grid: coordinates of a block that make its cells.
    cell_rows: vectors in one part of a cell. seed: of the rotation. Only the threshold changes the result."""

    threshold: float = 0.98
    blocks: int = 8
    grid: int = 3
    cell_rows: int = 4096
    seed: int = 5

    def classes(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
        """(key, n_links, component, kept) of every row: vectors with equal, non-null labels are compared.

        Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
        different lengths or rows without a key. Rows that repeat a key are one vector each to others; they count as
        links of others by row, and share their component.
        """
        rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
        if rows.schema["v"].dataType.elementType.simpleString() != "float":  # floats travel as such: half the bytes
            rows = rows.withColumn("v", F.col("v").cast("array<double>"))
        able = F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists(
            "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        ) & F.exists("v", lambda x: x != 0)
        zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
        usable = rows.where(F.coalesce(able, F.lit(False))).withColumn("v", F.transform("v", lambda x: F.when(x == 0, zero).otherwise(x)))  # no -0
        # Equal vectors are one class with a weight, however many: only classes are compared. A digest names the vector.
        digest = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
        classes = usable.groupBy("label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("key").alias("top"))
        classes = written_table(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("digest", digest))
        found = written_table(self._links(classes))
        degree = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        member = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
        least = member.join(classes.select("id", "top"), "id").groupBy("component").agg(F.min("top").alias("least"))
        linked = (
            classes.select("id", "label", "digest", "w", "top").join(degree, "id", "left")
            .join(member.join(least, "component").select("id", "least"), "id", "left")
            .select(F.col("label").alias("l"), F.col("digest").alias("g"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                    F.coalesce("least", "top").alias("top")).where("n_links > 0")
        )
        linked = broadcast_if_small(written_table(linked))
        each = usable.select("key", "label", digest.alias("digest"))
        each = each.join(linked, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("g")), "left").select("key", "n_links", "top")
        each = each.unionByName(rows.where(~F.coalesce(able, F.lit(False))).select("key"), allowMissingColumns=True)
        # rows of one key share the smallest component and the largest degree of its vectors
        by_key = each.where("key is not null and n_links is not null").groupBy("key").agg(F.max("n_links").alias("n_links"), F.min("top").alias("top"))
        out = (
            each.select("key").join(by_key, "key", "left")
            .select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "key").alias("component"))
        )
        return out.withColumn("kept", F.col("key") == F.col("component"))

    def _cells(self, usable: DataFrame) -> DataFrame:
        """(label, d, block, cell, home, id, w, v): each vector at home in one cell of each block, and in those it visits."""
        blocks, grid, seed, budget = self.blocks, self.grid, self.seed, 2 - 2 * self.threshold

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.asarray(batch.column(2).value_lengths())
                for d in np.unique(size):
                    pick = np.flatnonzero(size == d)
                    given = np.asarray(batch.column(2).take(pa.array(pick)).flatten()).reshape(len(pick), d)
                    x = given.astype(float)
                    x = x / np.abs(x).max(1, keepdims=True)
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    y = unit @ rotation(int(d), seed)
                    label, ids = batch.column(1).take(pa.array(pick)), np.asarray(batch.column(0))[pick]
                    weight = np.asarray(batch.column(3))[pick]
                    raw = [r.tobytes() for r in given]
                    for b, (lo, hi, share) in enumerate(subspaces(int(d), blocks)):
                        reach = np.sqrt(budget * share) + 1e-9
                        cell, home, row = visited(y[:, lo : min(hi, lo + grid)], reach)
                        yield pa.RecordBatch.from_arrays(
                            [label.take(pa.array(row)), pa.array(np.full(len(row), d, np.int32)), pa.array(np.full(len(row), b, np.int32)),
                             pa.array(cell), pa.array(home), pa.array(ids[row]), pa.array(weight[row]), pa.array(raw, pa.binary()).take(pa.array(row))],
                            names=["label", "d", "block", "cell", "home", "id", "w", "v"])

        kind = usable.schema["label"].dataType.simpleString()
        return usable.select("id", "label", "v", "w").mapInArrow(
            placed, f"label {kind}, d int, block int, cell long, home boolean, id long, w long, v binary"
        )

    def _links(self, usable: DataFrame) -> DataFrame:
        """Rows (a, null, n): n vectors linked to each of class a, found by one task; rows (a, b, 1): edges of a spanning forest."""
        blocks, seed, threshold = self.blocks, self.seed, self.threshold
        keys = ["label", "d", "block", "cell"]
        kind = np.float32 if usable.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
        cells = self._cells(usable)  # cheaper to make twice than to write
        many = cells.groupBy(*keys).count().where(F.col("count") > self.cell_rows)
        many = many.select(*keys, F.ceil(F.col("count") / self.cell_rows).cast("int").alias("_g"))
        dealt = cells.join(broadcast_if_small(many), keys, "left")
        # Parts p and q of a cell meet once in each order: pairs are looked for from what lives in p to all that is in q.
        own = F.pmod(F.xxhash64("id"), F.coalesce("_g", F.lit(1))).cast("int")
        all_parts = F.sequence(F.lit(0), F.coalesce("_g", F.lit(1)) - 1)

        def tile(p, q, lives, target):
            return F.struct(p.alias("p"), q.alias("q"), lives.alias("lives"), target.alias("target"))

        seen = F.transform(all_parts, lambda o: tile(o, own, F.col("home") & (o == own), F.lit(True)))
        seeing = F.transform(F.filter(all_parts, lambda o: o != own), lambda o: tile(own, o, F.lit(True), F.lit(False)))
        tiles = F.explode(F.concat(seen, F.when(F.col("home"), seeing).otherwise(F.filter(seeing, lambda _: F.lit(False)))))
        keys = [*keys, "p", "q"]
        dealt = dealt.withColumn("_t", tiles).select("*", "_t.*").repartition(*keys).sortWithinPartitions(*keys)

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in whole_runs(batches, ["d", "block", "cell", "p", "q"]):
                labels = np.asarray(table.column("label").combine_chunks().dictionary_encode().indices)
                d, block = table.column("d").to_numpy(), table.column("block").to_numpy()
                lives, ids = np.asarray(table.column("lives")).astype(bool), table.column("id").to_numpy()
                target = np.asarray(table.column("target")).astype(bool)
                v = table.column("v")
                w = table.column("w").to_numpy()
                degree: list[tuple[np.ndarray, np.ndarray]] = []
                edges: list[tuple[int, int]] = []
                for i, j in zip(starts[:-1], starts[1:], strict=True):
                    for lab in np.unique(labels[i:j]):
                        at = i + np.flatnonzero(labels[i:j] == lab)
                        if len(at) > 1 and lives[at].any():
                            x = np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), kind).astype(float).reshape(len(at), d[i])
                            n, e = cell_links(x, ids[at], w[at], lives[at], target[at], int(block[i]), blocks, seed, threshold)
                            degree.append((ids[at][n > 0], n[n > 0]))
                            edges += e
                ends = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in degree)])
                a, which = np.unique(ends, return_inverse=True)
                n = np.zeros(len(a), np.int64)
                np.add.at(n, which, np.concatenate([np.zeros(0, np.int64), *(x for _, x in degree)]))
                left = np.concatenate([a, np.array([x for x, _ in edges], np.int64)])
                right = pa.array([None] * len(a) + [y for _, y in edges], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left), right, pa.array(np.concatenate([n, np.ones(len(edges), np.int64)]))], names=["a", "b", "n"])

        return dealt.select(*keys, "lives", "target", "id", "w", "v").mapInArrow(linked, "a long, b long, n long")


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def subspaces(d: int, blocks: int) -> list[tuple[int, int, float]]:
    """(from, to, share of the budget) of each block: shares are in proportion to the coordinates."""
    cuts = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return [(int(a), int(b), (b - a) / d) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def visited(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, whether at home, row): cells as wide as twice the reach; a row visits the cells its reach touches."""
    n, g = x.shape
    width = 2 * reach
    own = np.floor(x / width).astype(np.int64)
    lower = np.floor((x - reach) / width).astype(np.int64)
    # in each coordinate the reach touches exactly two cells, or one more at a border, where a third adds no partner
    other = np.where(lower < own, own - 1, own + 1)
    cells, homes, rows = [], [], []
    for mask in range(1 << g):
        pick = np.array([(mask >> k) & 1 for k in range(g)], bool)
        c = np.where(pick, other, own)
        code = np.zeros(n, np.int64)
        for k in range(g):
            code = code * 1_048_583 + (c[:, k] + 500_000)
        cells.append(code)
        homes.append(np.full(n, mask == 0))
        rows.append(np.arange(n))
    return np.concatenate(cells), np.concatenate(homes), np.concatenate(rows)


def cell_links(
    x: np.ndarray, ids: np.ndarray, weight: np.ndarray, lives: np.ndarray, target: np.ndarray, block: int, blocks: int, seed: int,
    threshold: float, step: int = 1024, pairs: int = 1 << 15,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(vectors linked to each row, edges of a spanning forest) of the links from vectors that live here to targets.

    A link counts where its smaller id lives, and if no earlier block holds the pair within its budget. A partner counts with
    its weight. Pairs are checked ``pairs`` at a time, so that memory does not grow with the links of a cell.
    """
    n, d = x.shape
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])  # exact, and keeps squares from overflowing
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    parts = subspaces(d, blocks)
    budget = 2 - 2 * threshold
    y = unit @ rotation(d, seed)
    here, there = np.flatnonzero(lives), np.flatnonzero(target)
    tree = np.arange(n)
    degree, edges = np.zeros(n, np.int64), []
    for s in range(0, len(there), step):
        other = there[s : s + step]
        cosine = unit[here] @ unit[other].T
        row, column = np.nonzero((cosine >= threshold - 1e-9) & (ids[here][:, None] < ids[other][None, :]))
        for at in range(0, len(row), pairs):
            i, j = row[at : at + pairs], column[at : at + pairs]
            near = cosine[i, j]
            i, j = here[i], other[j]
            yes = near >= threshold + 1e-9
            close = np.flatnonzero(~yes)  # rounding could tell: these are computed anew
            ci, cj = i[close], j[close]
            yes[close] = (x[ci] * x[cj]).sum(1) / (norm[ci] * norm[cj]) >= threshold
            i, j = i[yes], j[yes]
            yes = np.ones(len(i), bool)
            gap = (y[i] - y[j]) ** 2
            for b, (lo, hi, share) in enumerate(parts[: block + 1]):
                within = gap[:, lo:hi].sum(1) <= budget * share + 1e-9
                yes &= within if b == block else ~within
            i, j = i[yes], j[yes]
            np.add.at(degree, i, weight[j])
            np.add.at(degree, j, weight[i])
            for a in np.unique(i):  # one row at a time: its links join it to each tree once
                mine = j[i == a]
                trees, first = np.unique(tree[mine], return_index=True)
                for t, c in zip(trees, mine[first], strict=True):
                    if t != tree[a]:
                        edges.append((int(ids[a]), int(ids[c])))
                        tree[tree == t] = tree[a]
    return degree, edges
