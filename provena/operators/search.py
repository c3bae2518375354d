"""Keyword, vector and fused search for whole batches of queries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena import schemas
from provena.functions.ranking import broadcast_if_small, query_blocks, top_k, union_all
from provena.functions.text import entity_codes
from provena.operators import clusters as cl
from provena.operators import impact as im
from provena.operators import index as ix
from provena.operators.chunking import chunk_total
from provena.session import shared_folder, written_table
from provena.sources.snapshots import Versions

# Default result length, depth of each leg before fusion, fallback fusion constant, swept constants.
TOP_K = 10
CANDIDATE_POOL = 50
FALLBACK_RRF_K = 60
RRF_K_SWEEP = (1, 10, 30, 60, 100)
METHODS = ("text", "vector", "hybrid")
# Entity code and the root name looked for in a query.
COUNTRY_KEYWORDS = {"KE": "kenya", "UG": "uganda", "TZ": "tanzania", "ET": "ethiopia", "RW": "rwanda"}

# Part of every fingerprint: changes when the tables of an index change.
INDEX_FORMAT = 6
# Excluded documents that are broadcast: eight bytes each.
MAX_EXCLUDED = 2_000_000
# Queries sent to the tasks at a time; larger batches are searched block by block.
MAX_QUERY_ROWS = 20_000


class StaleIndexError(RuntimeError):
    """The index was built against another corpus version than the current one."""


def excluded_by_status(lifecycle: DataFrame | None, status: str | None) -> DataFrame | None:
    """Documents the lifecycle filter keeps out before ranking; None where the filter is off."""
    if lifecycle is None or status is None:
        return None
    return lifecycle.where(F.col("lifecycle_status") != status).select("doc_id")


def recorded_rrf_k(config: DataFrame) -> Column:
    """The recorded fusion constant as a scalar; the fallback where none or another method is recorded."""
    return F.coalesce(
        config.agg(F.max(F.when(F.col("method") == "hybrid", F.col("rrf_k"))).alias("k")).scalar(),
        F.lit(FALLBACK_RRF_K),
    )


def record_default(config_path: str, spark, method: str, rrf_k: int | None, report: DataFrame) -> None:
    """Record method and constant; only after a report exists, and hybrid needs its constant."""
    if report.isEmpty():
        raise ValueError("no evaluation report: evaluate first, then record a default")
    if method == "hybrid" and rrf_k is None:
        raise ValueError("method 'hybrid' needs rrf_k")
    k = rrf_k if method == "hybrid" else None
    spark.createDataFrame([(method, k)], "method string, rrf_k int").coalesce(1).write.mode("overwrite").parquet(
        config_path
    )


def text_leg(index: ChunkIndex, qterms: Sequence[DataFrame], k: int, excluded: DataFrame | None = None) -> DataFrame:
    """Best ``k`` chunks per query by cosine of TF-IDF vectors, exact, scores above zero only.

    ``qterms`` holds the weighted terms of one query block each; ``query_blocks`` has bounded the text they come from.
    Only the blocks of the inverted index that can hold a chunk of the list are opened.
    """
    blocks = index.inverted
    if excluded is not None:
        excluded = excluded.select("doc_id").distinct()
        if excluded.limit(MAX_EXCLUDED + 1).count() > MAX_EXCLUDED:
            # too many to travel: the index is made anew without them
            blocks, excluded = written_table(im.blocks(index.searchable(excluded))), None
    return union_all([im.search(blocks, block, k, excluded) for block in qterms])


def vector_leg(index: cl.VectorIndex, queries: Sequence[DataFrame], k: int, excluded: DataFrame | None = None) -> DataFrame:
    """Best ``k`` vectors of the index per query vector (query_id, vec) by cosine, exact. Vectors of length zero have no cosine."""
    allowed = None if excluded is None else (lambda rows: rows.join(_gone(excluded), "doc_id", "left_anti"))
    return union_all([index.search(block, k, allowed) for block in queries])


def _gone(excluded: DataFrame) -> DataFrame:
    """The excluded ids are narrow: while they are few enough they travel, and the index stays where it is."""
    return broadcast_if_small(excluded.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), MAX_EXCLUDED)


def fuse(legs: Sequence[DataFrame], k: int | Column, top: int | None, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(k+rank) over the legs, ranks from 1.

    Equal scores keep first-seen order: the earlier leg first, then the rank in it. ``group`` may hold a column
    with the constant itself, so that several constants are fused in one pass.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    ranked = union_all([leg.select(*group, "chunk_id", "rank").withColumn("_leg", F.lit(i)) for i, leg in enumerate(legs)])
    scored = ranked.groupBy(*group, "chunk_id").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.min(F.struct("_leg", "rank")).alias("_seen")
    )
    order = [F.desc("score"), F.asc("_seen._leg"), F.asc("_seen.rank")]
    if top is None:
        w = Window.partitionBy(*group).orderBy(*order)
        out = scored.withColumn("rank", F.row_number().over(w))
    else:
        out = top_k(scored, list(group), order, top)
    return out.drop("_seen")


def boost(results: DataFrame, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Move results whose ``tags`` meet the query's ``detected`` codes to the front; order kept otherwise.

    Never drops a row. With nothing detected or nothing matching, the order does not change.
    """
    match = F.coalesce(F.arrays_overlap("tags", "detected"), F.lit(False)).cast("int")
    w = Window.partitionBy(*group).orderBy(F.desc("_match"), F.asc("rank"))
    return results.withColumn("_match", match).withColumn("rank", F.row_number().over(w)).drop("_match")


class ChunkIndex:
    """An index that is built once and searched many times: term statistics, blocks of chunks and their vectors.

    ``build`` writes them as tables to the shared folder, so that no leg, method or arm repeats the work on the
    text, and each leg reads only its own columns. ``rows``, one per chunk, are read off the blocks.
    """

    def __init__(self, docs: DataFrame, dim: int = ix.VECTOR_DIM):
        self.dim = dim
        self.n_chunks = chunk_total(docs)
        self._docs = docs
        self.stats = ix.with_idf(ix.count_window_terms(docs), self.n_chunks, dim)
        self.rows: DataFrame | None = None
        self.inverted: DataFrame | None = None
        self.vectors: cl.VectorIndex | None = None

    def build(self) -> ChunkIndex:
        self.stats = written_table(self.stats)
        self.inverted = written_table(im.document_blocks(self._docs, self.stats, self.n_chunks, self.dim))
        self.rows = im.block_rows(self.inverted)
        self.vectors = cl.VectorIndex.build(self._vectors(), "chunk_id", ("doc_id",))
        return self

    def _vectors(self) -> DataFrame:
        return im.block_vectors(self.inverted)

    def store(self, path: str) -> ChunkIndex:
        """Write all tables of the index below ``path``."""
        spark = self._docs.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        self.stats = stored(self.stats, "stats")
        self.inverted = stored(im.document_blocks(self._docs, self.stats, self.n_chunks, self.dim), "inverted")
        self.rows = im.block_rows(self.inverted)
        self.vectors = cl.VectorIndex.build(self._vectors(), "chunk_id", ("doc_id",), write=lambda df: stored(df, "vectors"))
        # at most ``MAX_CENTRES`` rows
        centres = [(c.tolist(),) for c in self.vectors.centres]
        stored(spark.createDataFrame(centres, "vec array<double>").select(F.monotonically_increasing_id().alias("cluster"), "vec").coalesce(1), "centres")
        return self

    def load(self, path: str) -> ChunkIndex:
        spark = self._docs.sparkSession
        self.stats = spark.read.schema(self.stats.schema).parquet(f"{path}/stats")
        self.inverted = spark.read.parquet(f"{path}/inverted")
        self.rows = im.block_rows(self.inverted)
        centres = [r["vec"] for r in spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()]
        self.vectors = cl.VectorIndex.opened(spark.read.parquet(f"{path}/vectors"), "chunk_id", np.array(centres).reshape(len(centres), -1))
        return self

    def searchable(self, excluded: DataFrame | None = None) -> DataFrame:
        """Rows search may return: (doc_id, chunk_id, terms, weights, norm, vec)."""
        if self.rows is None:
            self.build()
        if excluded is None:
            return self.rows
        # The excluded ids are narrow: while they are few enough they travel, and the index stays where it is.
        return self.rows.withColumn("doc_id", F.col("doc_id").cast("string")).join(_gone(excluded), "doc_id", "left_anti")

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        q = ix.query_terms(queries, self.stats)
        return ix.dense_vectors(ix.hashed_entries(q, ["query_id"]), ["query_id"], self.dim)


def index_documents(docs: DataFrame) -> ChunkIndex:
    """Index documents (doc_id, text): windows, weights, vectors. Built on first use."""
    return ChunkIndex(docs)


def content_fingerprint(docs: DataFrame) -> str:
    """Of all ids and texts, in any order: one narrow pass, next to nothing beside an index build."""
    h = F.xxhash64(F.lit(INDEX_FORMAT), "doc_id", "text")
    n, x, s = docs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0))).first()
    return f"{n}-{x & (2**64 - 1):016x}-{s:x}"


class IndexRegistry:
    """The indexes built for one corpus, and which of them is current.

    Each entry names a folder and carries the index's full stamp: embedding model, vector length, corpus version, content
    fingerprint, number of chunks, time. An entry appears in one step, and of two writers one comes through.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._entries = spark, path.rstrip("/"), Versions(spark, path)

    def current(self) -> dict | None:
        known = self._entries.numbers()
        return self._entries.get(known[-1]) if known else None

    def open(self, docs: DataFrame, corpus_version: str) -> ChunkIndex:
        """The current index, if it is that of ``docs`` at ``corpus_version``; a stale or missing index is an error.

        The corpus is fingerprinted, one narrow pass; ``corpus_version`` may carry a date after the version.
        """
        return self._open(docs, corpus_version, content_fingerprint(docs))

    def _open(self, docs: DataFrame, corpus_version: str, fingerprint: str) -> ChunkIndex:
        entry, now = self.current(), corpus_version.split()[0]
        if entry is None:
            raise StaleIndexError("no index: build the index first")
        if entry["corpus_version"] != now:
            raise StaleIndexError(f"index was built against {entry['corpus_version']!r}, the corpus is at {now!r}: rebuild it")
        if entry["fingerprint"] != fingerprint:
            raise StaleIndexError(f"documents of {now!r} have changed since their index was built: rebuild it")
        return index_documents(docs).load(f"{self.path}/{entry['folder']}")

    def publish(self, docs: DataFrame, corpus_version: str, model: str = "hashed-tfidf") -> ChunkIndex:
        """Build the index of ``docs`` and make it current. If another writer has published the same meanwhile, theirs is taken and ours removed."""
        return self._publish(docs, corpus_version, model, content_fingerprint(docs))

    def _publish(self, docs: DataFrame, corpus_version: str, model: str, fingerprint: str) -> ChunkIndex:
        folder, version = f"indexes/{uuid.uuid4().hex}", corpus_version.split()[0]
        index = index_documents(docs).store(f"{self.path}/{folder}")
        stamp = ix.index_stamp(index._vectors(), model, version, "").first().asDict()
        entry = stamp | {"fingerprint": fingerprint, "folder": folder, "created_at": datetime.now(UTC).strftime("%Y-%m-%d")}
        while True:
            known = self._entries.numbers()
            last = self._entries.get(known[-1]) if known else {}
            if last.get("fingerprint") == fingerprint and last.get("corpus_version") == version:
                self._entries.delete(folder)
                return index.load(f"{self.path}/{last['folder']}")
            if self._entries.put((known[-1] if known else 0) + 1, entry):
                return index

    def ensure(self, docs: DataFrame, corpus_version: str, model: str = "hashed-tfidf") -> ChunkIndex:
        """The current index if it is fresh, else a new one."""
        fingerprint = content_fingerprint(docs)
        try:
            return self._open(docs, corpus_version, fingerprint)
        except StaleIndexError:
            return self._publish(docs, corpus_version, model, fingerprint)

    def stamp(self) -> DataFrame:
        """The stamp of the current index as a table; empty where there is none."""
        entry = self.current()
        schema = schemas.INDEX_STAMP + ", fingerprint string"
        columns = [f.name for f in schemas.fields(schema)]
        return self.spark.createDataFrame([tuple(entry[c] for c in columns)] if entry else [], schema)

    def expire(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` entries and delete the folders that none of these names. Returns the deleted folders."""
        known = self._entries.numbers()
        used = {self._entries.get(n)["folder"] for n in known[-keep:]}
        for n in known[:-keep]:
            self._entries.forget(n)
        gone = [f for f in (f"indexes/{name}" for name in self._entries.folders("indexes")) if f not in used]
        for f in gone:
            self._entries.delete(f)
        return gone


def shared_registry(spark: SparkSession, name: str) -> IndexRegistry:
    """The registry of the corpus ``name`` in the shared folder."""
    return IndexRegistry(spark, f"{shared_folder(spark)}/index-{INDEX_FORMAT}/{name}")


def shared_index(docs: DataFrame, corpus_version: str, model: str = "hashed-tfidf", name: str = "corpus") -> ChunkIndex:
    """The fresh index of a corpus in the shared folder: opened if it is there, built and published if not."""
    return shared_registry(docs.sparkSession, name).ensure(docs, corpus_version, model)


def legs(
    index: ChunkIndex, queries: DataFrame, depth: int, excluded: DataFrame | None, method: str
) -> list[DataFrame]:
    """The ranked lists a method fuses, text first. ``queries`` has query_id and text."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: expected 'text', 'vector' or 'hybrid'")
    if index.rows is None:
        index.build()
    blocks = query_blocks(queries, "query_id", "text", MAX_QUERY_ROWS)
    out = []
    if method in ("text", "hybrid"):
        out.append(text_leg(index, [ix.query_terms(b, index.stats) for b in blocks], depth, excluded))
    if method in ("vector", "hybrid"):
        out.append(vector_leg(index.vectors, [index.query_vectors(b) for b in blocks], depth, excluded))
    return out


def search(
    index: ChunkIndex | IndexRegistry,
    queries: DataFrame,
    tags: DataFrame | None = None,
    top: int = TOP_K,
    method: str = "hybrid",
    lifecycle: DataFrame | None = None,
    lifecycle_status: str | None = "active",
    rrf_k: int | Column | None = None,
    entity_boost: bool = True,
    keywords: Mapping[str, str] = COUNTRY_KEYWORDS,
    config: DataFrame | None = None,
    docs: DataFrame | None = None,
    corpus_version: str | None = None,
) -> DataFrame:
    """Ranked results (query_id, chunk_id, doc_id, rank, score) for every query of the batch.

    ``index`` is an index or a registry; a registry is asked for that of ``docs`` at ``corpus_version`` and refuses to search
    a stale one (``StaleIndexError``).

    ``tags`` is (doc_id, tags), ``lifecycle`` is (doc_id, lifecycle_status). The pool is widened to ``CANDIDATE_POOL`` only for queries in which an entity is
    detected; for the others the first ``top`` rows of the same pool are the same rows. Only hybrid results
    carry a score, as in the data model. Without ``rrf_k`` the constant recorded in ``config`` is taken.
    """
    if isinstance(index, IndexRegistry):
        if docs is None or corpus_version is None:
            raise ValueError("a registry needs docs and corpus_version, to tell a stale index")
        index = index.open(docs, corpus_version)
    pool = max(top, CANDIDATE_POOL)
    if rrf_k is None:  # the recorded constant, at the time of the call
        rrf_k = FALLBACK_RRF_K if config is None else recorded_rrf_k(config)
    ranked = legs(index, queries, CANDIDATE_POOL, excluded_by_status(lifecycle, lifecycle_status), method)
    if method == "hybrid":
        res = fuse(ranked, rrf_k, pool)
    else:
        res = ranked[0].select("query_id", "chunk_id", "rank").withColumn("score", F.lit(None).cast("double"))
    res = with_doc_id(res)
    if entity_boost and tags is not None:
        facts = attach(res, queries, tags.select("doc_id", "tags"), keywords)
        res = boost(facts).drop("tags", "detected")
    return res.where(F.col("rank") <= top)


def with_doc_id(res: DataFrame) -> DataFrame:
    """Document id read back from the chunk id."""
    return res.withColumn("doc_id", F.regexp_extract("chunk_id", r"^(.+)-chunk-\d+$", 1))


def with_texts(res: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, n_retrieved, retrieved_chunks): for every query the texts of its results by chunk id, as an answer keeps them.

    The results are the small side: chunks (chunk_id, text) are filtered by them where they are read.
    """
    wanted = res.select("query_id", "chunk_id").distinct()
    hit = chunks.select("chunk_id", "text").join(broadcast_if_small(wanted), "chunk_id")
    texts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))))
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_retrieved"), texts.alias("retrieved_chunks"))


def attach(res: DataFrame, queries: DataFrame, tags: DataFrame, keywords: Mapping[str, str]) -> DataFrame:
    """Add the document's tags (and whatever else ``tags`` holds) and the query's detected codes to a result list.

    The result list is small (queries x pool), so the join keeps the document side where it is scanned.
    """
    found = queries.select("query_id", entity_codes("text", keywords).alias("detected"))
    t = tags.withColumn("doc_id", F.col("doc_id").cast("string"))
    return res.join(t, "doc_id", "left").join(found, "query_id", "left")
