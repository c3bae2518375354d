"""Inputs every registered query derives from the given tables, and the same derivations as SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small, query_blocks, spread  # noqa: F401
from provena.functions.text import WS, entity_codes
from provena.operators.chunking import chunk_documents
from provena.operators.search import ChunkIndex, excluded_by_status, shared_index

# Entity codes of the driver corpus: a language marker each.
ENTITY_KEYWORDS = {"en": "the", "fr": "que", "de": "und", "es": "ción"}
CORPUS_VERSION = "v1.0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table, spread over all cores where its file is small."""
    return spread(table(spark, sf, "documents"))


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lifecycle_status): a document labelled toxic is retracted, any other is active."""
    status = F.when(F.col("toxic") == 1, "retracted").otherwise("active")
    return table(spark, sf, "labels").select("doc_id", status.alias("lifecycle_status"))


def inactive(spark: SparkSession, sf: str) -> DataFrame:
    return excluded_by_status(lifecycle(spark, sf), "active")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(documents(spark, sf), keep=["source", "lang"])


def corpus_index(spark: SparkSession, sf: str) -> ChunkIndex:
    """The index of the tables in ``sf``: each folder is a corpus of its own."""
    return shared_index(documents(spark, sf), CORPUS_VERSION, name=hashlib.sha256(sf.encode()).hexdigest()[:16])


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages as a batch of queries, with the category their entities give them."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    codes = entity_codes("text", ENTITY_KEYWORDS)
    return b.withColumn(
        "category",
        F.when(F.size(codes) > 1, F.lit("multi_entity"))
        .when(F.size(codes) == 1, F.element_at(codes, 1))
        .otherwise(F.lit("general")),
    )


def doc_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("organization"), F.array("lang", "source").alias("tags"))


CATEGORIES = ["multi_entity", "en", "fr", "de", "es", "general"]

# ---- the same as SQL -------------------------------------------------------------------------------------

WS_SQL = WS


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{WS}+|{WS}+\z', '', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_codes(e: str, keywords=None) -> str:
    kw = keywords or ENTITY_KEYWORDS
    parts = ", ".join(f"CASE WHEN contains(lower({e}), '{k}') THEN '{c}' END" for c, k in kw.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


SQL_DOCS = """docs AS (
  SELECT d.doc_id, d.text, d.source AS organization, d.lang, d.n_chars,
         CASE WHEN l.toxic = 1 THEN 'retracted' ELSE 'active' END AS lifecycle_status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

SQL_CHUNKS = """chunks AS (
  SELECT doc_id, organization, lang, lifecycle_status, n_chars, i AS chunk_index,
         printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), i) AS chunk_id,
         i * 750 AS char_start, least(i * 750 + 1500, n_chars) AS char_end,
         substring(text, i * 750 + 1, 1500) AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN n_chars = 0 THEN 0
               ELSE CAST(greatest(0, ceil((n_chars - 1500) / 750.0)) AS INTEGER) + 1 END)) AS i FROM docs))"""

SQL_TFIDF = r"""tf AS (
  SELECT chunk_id, term, count(*) AS tf FROM (
    SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM chunks) GROUP BY ALL),
stats AS (
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf GROUP BY term),
w AS (SELECT chunk_id, term, tf.tf * idf AS w FROM tf JOIN stats USING (term)),
norms AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY chunk_id),
qtf AS (
  SELECT query_id, term, count(*) AS tf FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM queries) GROUP BY ALL),
qw AS (SELECT query_id, term, qtf.tf * idf AS w FROM qtf JOIN stats USING (term)),
qnorms AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query_id)"""

SQL_QUERIES = f"""queries AS (
  SELECT query_id, text, codes, CASE WHEN len(codes) > 1 THEN 'multi_entity' WHEN len(codes) = 1 THEN codes[1]
         ELSE 'general' END AS category
  FROM (SELECT item_id AS query_id, text, {sql_codes('text')} AS codes FROM benchmark))"""

SQL_TEXT_LEG = """text_leg AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT qw.query_id, w.chunk_id, round(sum(qw.w * w.w) / (any_value(norm) * any_value(qnorm)), 9) AS score
      FROM qw JOIN w ON w.term = qw.term JOIN norms ON norms.chunk_id = w.chunk_id
      JOIN qnorms ON qnorms.query_id = qw.query_id
      JOIN chunks ON chunks.chunk_id = w.chunk_id AND chunks.lifecycle_status = 'active'
      GROUP BY qw.query_id, w.chunk_id) WHERE score > 0) WHERE rank <= 50)"""

SQL_HASHED = """hashed AS (
  SELECT chunk_id, bucket, sum(CASE WHEN sign THEN w ELSE -w END) AS v FROM (
    SELECT chunk_id, w, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS bucket,
           contains('02468ace', substr(md5(term), 32, 1)) AS sign FROM w) GROUP BY ALL),
qhashed AS (
  SELECT query_id, bucket, sum(CASE WHEN sign THEN w ELSE -w END) AS v FROM (
    SELECT query_id, w, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS bucket,
           contains('02468ace', substr(md5(term), 32, 1)) AS sign FROM qw) GROUP BY ALL)"""

SQL_VECTOR_LEG = """hnorm AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM hashed GROUP BY chunk_id),
qhnorm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qhashed GROUP BY query_id),
vector_leg AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.query_id, c.chunk_id,
             round(coalesce(sum(q.v * h.v), 0) / (any_value(q2.n) * any_value(c.n)), 9) AS score
      FROM qhashed q JOIN qhnorm q2 ON q2.query_id = q.query_id AND q2.n > 0
      JOIN hashed h ON h.bucket = q.bucket
      JOIN hnorm c ON c.chunk_id = h.chunk_id AND c.n > 0
      JOIN chunks ON chunks.chunk_id = c.chunk_id AND chunks.lifecycle_status = 'active'
      GROUP BY q.query_id, c.chunk_id)) WHERE rank <= 50)"""

SQL_LEGS = ",\n".join([SQL_DOCS, SQL_CHUNKS, SQL_QUERIES, SQL_TFIDF, SQL_TEXT_LEG, SQL_HASHED, SQL_VECTOR_LEG])


def sql_fused(name: str = "fused", k: str = "10", depth: int = 50) -> str:
    return f"""{name} AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leg, r0) AS rank FROM (
      SELECT query_id, chunk_id, sum(1.0::DOUBLE / ({k} + rank)) AS score, min(leg) AS leg,
             arg_min(rank, leg) AS r0
      FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM text_leg
            UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vector_leg) GROUP BY query_id, chunk_id))
  WHERE rank <= {depth})"""


SQL_DOC_OF = "CAST(regexp_extract(chunk_id, '^(.+)-chunk-[0-9]+$', 1) AS BIGINT)"
