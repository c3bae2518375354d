"""Registered queries: chunks, indexes and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import clusters as cl
from provena.operators import index as ix
from provena.operators import search as se
from provena.operators.chunking import chunk_total
from provena.plans import common as c
from provena.session import written_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@register(
    "chunk_windows",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}
    SELECT chunk_id, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_start AS INTEGER) AS char_start,
           CAST(char_end AS INTEGER) AS char_end, sha256(text) AS text_sha256 FROM chunks""",
)
def chunk_windows(spark, sf):
    ch = c.chunks(spark, sf)
    return ch.select("chunk_id", "doc_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@register(
    "tfidf_postings",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, queries AS (SELECT 0 AS query_id, '' AS text), {c.SQL_TFIDF}
    SELECT tf.term, CAST(any_value(df) AS BIGINT) AS df, CAST(sum(tf.tf) AS BIGINT) AS cf,
           round(any_value(idf), 6) AS idf, round(sum(w.w / norm), 6) AS mass
    FROM tf JOIN stats USING (term) JOIN w ON w.chunk_id = tf.chunk_id AND w.term = tf.term
    JOIN norms ON norms.chunk_id = tf.chunk_id GROUP BY tf.term""",
)
def tfidf_postings(spark, sf):
    """The keyword index by term: document and collection frequency, idf and the sum of normalized weights."""
    n = chunk_total(c.table(spark, sf, "documents"))
    chunks = c.chunks(spark, sf)
    agg = ix.term_masses(chunks, written_table(ix.count_terms(chunks)), n)
    return agg.select(
        "term", "df", "cf", F.round(ix.idf(F.col("df"), n), 6).alias("idf"), F.round("mass", 6).alias("mass")
    )


@register(
    "text_search_topk",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, {c.SQL_QUERIES}, {c.SQL_TFIDF}, {c.SQL_TEXT_LEG}
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM text_leg WHERE rank <= 10""",
)
def text_search_topk(spark, sf):
    (leg,) = se.legs(c.corpus_index(spark, sf), c.queries(spark, sf), se.TOP_K, c.inactive(spark, sf), "text")
    return leg.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register(
    "vector_search_topk",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    q AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i),
    qn AS (SELECT label, sqrt(sum(x * x)) AS n FROM q GROUP BY label),
    en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
    s AS (SELECT q.label, e.vec_id, round(sum(q.x * e.x) / (any_value(qn.n) * any_value(en.n)), 9) AS score
          FROM q JOIN e ON e.i = q.i JOIN qn ON qn.label = q.label JOIN en ON en.vec_id = e.vec_id
          GROUP BY q.label, e.vec_id)
    SELECT CAST(label AS INTEGER) AS query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_search_topk(spark, sf):
    """The ten vectors nearest to every label's mean vector."""
    e = c.table(spark, sf, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
        .withColumnRenamed("label", "query_id")
    )
    index = cl.VectorIndex.build(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id")
    res = se.vector_leg(index, [means], se.TOP_K)
    return res.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register(
    "hashed_vectors",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, queries AS (SELECT 0 AS query_id, '' AS text), {c.SQL_TFIDF}, {c.SQL_HASHED}
    SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, round(v, 6) AS value FROM hashed""",
)
def hashed_vectors(spark, sf):
    return ix.bucket_sums(c.corpus_index(spark, sf).searchable()).withColumn("value", F.round("value", 6))


@register(
    "index_stamp",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}
    SELECT 'hashed-tfidf' AS embedding_model, 64 AS embedding_dim, 'v1.0' AS corpus_version,
           CAST(count(*) AS BIGINT) AS chunk_count, '2026-01-01' AS created_at FROM chunks
    WHERE len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) > 0""",
)
def index_stamp(spark, sf):
    return ix.index_stamp(c.corpus_index(spark, sf).searchable(), "hashed-tfidf", c.CORPUS_VERSION, "2026-01-01")


@register(
    "rrf_hybrid_topk",
    f"""WITH {c.SQL_LEGS}, {c.sql_fused()}
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM fused WHERE rank <= 10""",
)
def rrf_hybrid_topk(spark, sf):
    """Hybrid search with the recorded fusion constant, read from a one-row configuration."""
    config = spark.range(1).select(F.lit("hybrid").alias("method"), F.lit(10).alias("rrf_k"))
    res = se.search(
        c.corpus_index(spark, sf), c.queries(spark, sf), lifecycle=c.lifecycle(spark, sf),
        rrf_k=se.recorded_rrf_k(config), entity_boost=False,
    )
    return res.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@register(
    "retrieved_texts",
    f"""WITH {c.SQL_LEGS}, {c.sql_fused()} SELECT query_id, f.chunk_id, sha256(ch.text) AS text_sha256, CAST(count(*) OVER (PARTITION BY query_id) AS INTEGER) AS n_retrieved
    FROM fused f JOIN chunks ch USING (chunk_id) WHERE rank <= 10""",
)
def retrieved_texts(spark, sf):
    """The texts that go with each query's results, unpacked from the map an answer keeps."""
    res = se.search(c.corpus_index(spark, sf), c.queries(spark, sf), lifecycle=c.lifecycle(spark, sf), rrf_k=10, entity_boost=False)
    kept = se.with_texts(res, c.chunks(spark, sf))
    return kept.select("query_id", "n_retrieved", F.explode("retrieved_chunks").alias("chunk_id", "t")).select(
        "query_id", "chunk_id", F.sha2("t", 256).alias("text_sha256"), "n_retrieved"
    )


@register(
    "rrf_k_sweep",
    f"""WITH {c.SQL_LEGS}, ks AS (SELECT unnest([1, 10, 30, 60, 100]) AS k),
    f AS (SELECT k, query_id, chunk_id, sum(1.0::DOUBLE / (k + rank)) AS score, min(leg) AS leg, arg_min(rank, leg) AS r0
      FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM text_leg
            UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vector_leg), ks GROUP BY k, query_id, chunk_id)
    SELECT CAST(k AS INTEGER) AS rrf_k, query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, leg, r0) AS rank FROM f) WHERE rank <= 10""",
)
def rrf_k_sweep(spark, sf):
    """Every swept constant from one run of the legs."""
    legs = se.legs(c.corpus_index(spark, sf), c.queries(spark, sf), se.CANDIDATE_POOL, c.inactive(spark, sf), "hybrid")
    ks = F.explode(F.array(*[F.lit(k) for k in se.RRF_K_SWEEP]))
    swept = [leg.withColumn("rrf_k", ks) for leg in legs]
    res = se.fuse(swept, F.col("rrf_k"), se.TOP_K, group=("rrf_k", "query_id"))
    return res.select("rrf_k", "query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


SQL_BOOSTED = f"""boosted AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, rank) AS rank FROM (
    SELECT f.*, CASE WHEN list_has_any(q.codes, [d.lang, d.source]) THEN 1 ELSE 0 END AS m
    FROM (SELECT *, {c.SQL_DOC_OF} AS doc_id FROM fused) f JOIN queries q USING (query_id)
    JOIN documents d ON d.doc_id = f.doc_id))"""


@register(
    "entity_boost_rerank",
    f"""WITH {c.SQL_LEGS}, {c.sql_fused()}, {SQL_BOOSTED}
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM boosted WHERE rank <= 10""",
)
def entity_boost_rerank(spark, sf):
    res = se.search(
        c.corpus_index(spark, sf),
        c.queries(spark, sf),
        tags=c.doc_tags(spark, sf),
        lifecycle=c.lifecycle(spark, sf),
        rrf_k=10,
        keywords=c.ENTITY_KEYWORDS,
    )
    return res.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))
