"""Exact nearest vectors from a partitioned index.

Vectors lie in clusters around centres, sorted by cluster, and every cluster knows the widest angle from its centre to a
member. Angles obey the triangle inequality: a query further from a centre than that angle and the angle of its k-th
best vector so far has nothing to find there. What is left of the clusters is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.ranking import query_blocks, top_k, union_all
from provena.session import written_table

# Centres are fitted on so many vectors at most; every vector is indexed.
SAMPLE_ROWS = 20_000
MAX_CENTRES = 1024
ROUNDS = 8
# Queries that travel at a time: with all centres, 4 million angles.
MAX_QUERY_ROWS = 4096
# Scores held at a time by one task.
SCORES = 4_000_000
# Scores are compared after rounding, so that the order of float additions cannot decide a rank.
SCORE_DIGITS = 9
# Angles are float; a cluster is left out only if it misses by more than this.
SLACK = 1e-6

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the rows that have a direction: null, zero and non-finite vectors have none."""
    filled = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    held = column.take(pa.array(filled))
    if len(held) == 0:
        return filled, np.zeros((0, 0))
    flat = held.flatten().cast(pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(len(held), -1)
    n = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(n) & (n > 0)
    return filled[ok], m[ok] / n[ok, None]


def fit_centres(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n`` unit centres of unit vectors: the rows furthest from those before, then moved to the mean of their members."""
    x = np.unique(x, axis=0)
    if len(x) <= n:
        return x
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(n - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def fan(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0..count-1) for every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class VectorIndex:
    """``rows`` (cluster, angle, id, vec and what was kept); ``centres`` and, by cluster, ``radius`` and ``size``."""

    def __init__(self, rows: DataFrame, id_col: str, centres: np.ndarray, radius: np.ndarray, size: np.ndarray):
        self.rows, self.id_col, self.centres, self.radius, self.size = rows, id_col, centres, radius, size
        #: vectors scored and vectors there were, over all queries of the last search
        self.scored = self.possible = 0

    @classmethod
    def build(cls, corpus: DataFrame, id_col: str, keep: tuple[str, ...] = (), centres: int | None = None, write: Callable = written_table) -> VectorIndex:
        """Index ``corpus`` (``id_col``, vec): centres from a bounded sample chosen by hash, then every vector to its nearest centre.

        The table is ordered by cluster and id hash: a cluster of any size is spread over many tasks, and a filter on clusters skips files.
        """
        usable = corpus.where(F.col("vec").isNotNull()).select(id_col, "vec", *keep)
        n = usable.count()
        sample = usable.select("vec").orderBy(F.xxhash64(F.lit("centre"), id_col), id_col).limit(SAMPLE_ROWS).toArrow()
        _, x = unit_rows(sample.column("vec").combine_chunks())
        c = fit_centres(x, centres or min(MAX_CENTRES, int(np.ceil(np.sqrt(max(n, 1))))))
        schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType()), *usable.schema.fields])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                step = max(1, SCORES // max(len(c), 1))
                for b in (big.slice(at, step) for at in range(0, big.num_rows, step)):
                    place, unit = unit_rows(b.column("vec"))
                    if len(place) == 0:
                        continue
                    cosine = unit @ c.T
                    own = np.argmax(cosine, axis=1)
                    held = b.take(pa.array(place))
                    far = angle(cosine[np.arange(len(own)), own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.astype(np.int32)), pa.array(far), *held.columns], names=["cluster", "angle", *held.schema.names]
                    )

        rows = usable.limit(0).select(F.lit(0).alias("cluster"), F.lit(0.0).alias("angle"), "*") if len(c) == 0 else usable.mapInArrow(assign, schema)
        rows = write(rows.repartitionByRange("cluster", F.xxhash64(id_col)).sortWithinPartitions("cluster"))
        return cls.opened(rows, id_col, c)

    @classmethod
    def opened(cls, rows: DataFrame, id_col: str, centres: np.ndarray) -> VectorIndex:
        radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in rows.groupBy("cluster").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per centre
            radius[r["cluster"]], size[r["cluster"]] = r["r"], r["n"]
        return cls(rows, id_col, centres, radius, size)

    def search(self, queries: DataFrame, k: int, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` nearest vectors of every query (query_id, vec) by cosine; ties by id.

        ``allowed`` filters the index rows that may be returned. A batch is measured in rows and bytes and cut into blocks.
        """
        blocks = query_blocks(queries, "query_id", F.size("vec") * 8, MAX_QUERY_ROWS)
        return union_all([self._block(b, k, allowed or (lambda rows: rows)) for b in blocks])

    def _block(self, queries: DataFrame, k: int, allowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        got = queries.select("query_id", "vec").toArrow().sort_by("query_id")  # a block's vectors
        place, q = unit_rows(got.column("vec").combine_chunks()) if got.num_rows else (np.zeros(0, int), np.zeros((0, 0)))
        ids = got.column("query_id").combine_chunks().take(pa.array(place, pa.int64()))
        if len(place) == 0 or len(self.centres) == 0:
            fields = [queries.schema["query_id"], self.rows.schema[self.id_col], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
            return queries.sparkSession.createDataFrame([], T.StructType(fields))
        to_centre = angle(q @ self.centres.T)
        # first the nearest clusters that hold k vectors together
        near = np.argsort(to_centre, axis=1, kind="stable")
        ahead = np.cumsum(self.size[near], axis=1) - self.size[near]
        first = np.zeros(to_centre.shape, bool)
        np.put_along_axis(first, near, (ahead < k) & (self.size[near] > 0), axis=1)
        seed = written_table(self._scored(ids, q, first, np.full(len(q), -np.inf), k, allowed))
        least = seed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        by_id = {r["query_id"]: r["least"] for r in least.collect()}  # a number per query of the block
        least = np.array([by_id.get(i, -1.0) for i in ids.to_pylist()])
        reach = np.where(least > -1.0, angle(least - SLACK), np.pi)
        open_ = (to_centre - self.radius[None, :] <= reach[:, None] + SLACK) & (self.size > 0) & ~first
        self.scored = int(((open_ | first) * self.size).sum())
        self.possible = int(self.size.sum()) * len(q)
        order = [F.desc("score"), F.asc(self.id_col)]
        late = self._scored(ids, q, open_, least - SLACK, k, allowed)
        return top_k(seed.drop("rank").unionByName(late.drop("rank")), ["query_id"], order, k)

    def _scored(self, ids: pa.Array, q: np.ndarray, pairs: np.ndarray, floor: np.ndarray, k: int, allowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The best ``k`` of the clusters in ``pairs`` (query x cluster) above each query's ``floor``; a task hands on ``k`` rows a query."""
        id_col, rows = self.id_col, self.rows
        wanted = np.flatnonzero(pairs.any(axis=0))
        of = {int(c): np.flatnonzero(pairs[:, c]) for c in wanted}
        model = rows.sparkSession.sparkContext.broadcast((q, of, floor, ids.to_pylist()))
        kind = ARROW[rows.schema[id_col].dataType.simpleString()]
        q_kind = ids.type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit_q, of, floor, names = model.value
            best = Best(len(unit_q), k, floor)
            for big in batches:
                cluster = big.column("cluster").to_numpy()
                for c in np.unique(cluster).tolist():
                    asked = of.get(c)
                    if asked is None:
                        continue
                    at = np.flatnonzero(cluster == c)
                    step = max(1, SCORES // len(asked))
                    for part in (at[i : i + step] for i in range(0, len(at), step)):
                        held = big.take(pa.array(part))
                        _, unit = unit_rows(held.column("vec"))
                        best.add(np.round(unit @ unit_q[asked].T, SCORE_DIGITS) + 0.0, asked, np.array(held.column(id_col).to_pylist()))
            query, found, score = best.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in query.tolist()], q_kind), pa.array(found.tolist(), kind), pa.array(score, pa.float64())],
                names=["query_id", id_col, "score"],
            )

        query_type = {str(v): T for v, T in ((pa.int64(), "bigint"), (pa.int32(), "int"), (pa.string(), "string"), (pa.large_string(), "string"))}
        open_rows = allowed(rows.where(F.col("cluster").isin([int(c) for c in wanted]))).select("cluster", id_col, "vec")
        out = open_rows.mapInArrow(run, f"query_id {query_type[str(q_kind)]}, {id_col} {rows.schema[id_col].dataType.simpleString()}, score double")
        return top_k(out, ["query_id"], [F.desc("score"), F.asc(id_col)], k)


class Best:
    """The best ``k`` rows of every query so far, cut whenever much has gathered."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.least = k, floor.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, score: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> None:
        row, col = np.nonzero(score >= self.least[asked][None, :])
        self.add_pairs(asked[col], ids[row], score[row, col])

    def add_pairs(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.held += len(query)
        if self.held > min(SCORES, 4 * self.k * len(self.least)):
            self.cut()

    def cut(self) -> None:
        query, ids, score = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        _, number = np.unique(ids.astype(str) if ids.dtype == object else ids, return_inverse=True)
        by = np.lexsort((number, -score, query))
        query, ids, score = query[by], ids[by], score[by]
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[: len(query)])
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        keep = place < self.k
        self.parts, self.held = [(query[keep], ids[keep], score[keep])], int(keep.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.cut()
        return self.parts[0]
