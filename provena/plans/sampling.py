"""Registered queries: samples for review and the tiered release."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import release as rl
from provena.operators.chunking import chunk_documents, window_count
from provena.operators import sampling as sm
from provena.plans import answers as an
from provena.plans import common as c
from provena.session import cut_lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}
TARGETS = {"en": 30, "fr": 20, "de": 100}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def docs(spark, sf):
    return c.table(spark, sf, "documents").select("doc_id", "lang", "source")


_R = "row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id)"


@register(
    "stratified_fixed",
    f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_R} AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 20 WHEN 'de' THEN 100 ELSE 0 END",
)
def stratified_fixed(spark, sf):
    return sm.stratified_fixed(docs(spark, sf), "lang", "doc_id", TARGETS).select("doc_id", "lang")


@register(
    "stratified_proportional",
    f"""WITH n AS (SELECT lang, CAST(round_even(50 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 0) AS BIGINT) AS k FROM documents GROUP BY lang)
    SELECT doc_id, lang FROM (SELECT doc_id, lang, {_R} AS r FROM documents) JOIN n USING (lang) WHERE r <= k""",
)
def stratified_proportional(spark, sf):
    return sm.stratified_proportional(docs(spark, sf), "lang", "doc_id", 50).select("doc_id", "lang")


SQL_LR = """cnt AS (SELECT source, count(*) AS n, min(doc_id) AS f, 77 * count(*) / (SELECT count(*) FROM documents)::DOUBLE AS raw FROM documents GROUP BY source),
lr AS (SELECT source, CAST(floor(raw) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 12) DESC, f) <= 77 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS n_take FROM cnt)"""


@register("largest_remainder_sizes", f"WITH {SQL_LR} SELECT source, CAST(n_take AS BIGINT) AS n_take FROM lr")
def largest_remainder_sizes(spark, sf):
    return sm.largest_remainder_sizes(docs(spark, sf), "source", 77, "doc_id")


@register(
    "largest_remainder",
    f"WITH {SQL_LR} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) JOIN lr USING (source) WHERE r <= n_take",
)
def largest_remainder(spark, sf):
    return sm.largest_remainder(docs(spark, sf), "source", "doc_id", 77, "doc_id").select("doc_id", "source")


@register(
    "calibration_sample",
    f"""WITH {an.SQL_ANS}, {an.SQL_CLAIMS}, bad AS (SELECT judgment_id, verdict FROM jv WHERE verdict IN ('unsupported', 'partial')),
    good AS (SELECT judgment_id, verdict FROM jv WHERE verdict = 'supported' ORDER BY md5('42:' || judgment_id), judgment_id LIMIT greatest(0, 65 - (SELECT count(*) FROM bad)))
    SELECT judgment_id, verdict, row_number() OVER (ORDER BY md5('43:' || judgment_id), judgment_id) AS position FROM (FROM bad UNION ALL FROM good)""",
)
def calibration_sample(spark, sf):
    return sm.calibration_sample(cut_lineage(an.judgments(spark, sf).select("judgment_id", "verdict")))


@register(
    "calibration_fill",
    """WITH s AS (SELECT 'doc' || doc_id AS judgment_id, CASE WHEN toxic = 1 THEN 'unsupported' ELSE 'supported' END AS verdict FROM labels),
    bad AS (SELECT * FROM s WHERE verdict = 'unsupported'), good AS (SELECT * FROM s WHERE verdict = 'supported' ORDER BY md5('42:' || judgment_id), judgment_id LIMIT greatest(0, 65 - (SELECT count(*) FROM bad)))
    SELECT judgment_id, verdict, row_number() OVER (ORDER BY md5('43:' || judgment_id), judgment_id) AS position FROM (FROM bad UNION ALL FROM good)""",
)
def calibration_fill(spark, sf):
    """The same sample over human labels, where few judgments are doubtful."""
    s = c.table(spark, sf, "labels").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("judgment_id"), F.when(F.col("toxic") == 1, "unsupported").otherwise("supported").alias("verdict")
    )
    return sm.calibration_sample(s)


@register(
    "deployment_sample",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 15",
)
def deployment_sample(spark, sf):
    return sm.per_category(docs(spark, sf), "source", "doc_id").select("doc_id", "source")


@register(
    "review_sample",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, s AS (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25)
    SELECT s.doc_id, printf('%s-chunk-%04d', CAST(s.doc_id AS VARCHAR), (s.doc_id * 7) % (greatest(0, CAST(ceil((d.n_chars - 1500) / 750.0) AS BIGINT)) + 1)) AS chunk_id, sha256(ch.text) AS chunk_sha256
    FROM s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN chunks ch ON ch.doc_id = s.doc_id AND ch.chunk_index = (s.doc_id * 7) % (greatest(0, CAST(ceil((d.n_chars - 1500) / 750.0) AS BIGINT)) + 1)""",
)
def review_sample(spark, sf):
    """Twenty-five items with the text of their window attached."""
    s = sm.review_sample(docs(spark, sf).select("doc_id"), "doc_id").select("doc_id")
    # at most 25 rows by construction: their documents alone are cut into windows, and nothing else is moved
    d = c.table(spark, sf, "documents").join(F.broadcast(s), "doc_id").select("doc_id", "text", "n_chars")
    item = d.select("doc_id", ((F.col("doc_id") * 7) % F.greatest(window_count("n_chars"), F.lit(1))).alias("i"))
    item = item.select("doc_id", F.format_string("%s-chunk-%04d", F.col("doc_id").cast("string"), "i").alias("chunk_id"))
    ch = chunk_documents(d.select("doc_id", "text")).select("chunk_id", F.sha2("text", 256).alias("chunk_sha256"))
    return item.join(ch, "chunk_id", "left").select("doc_id", "chunk_id", "chunk_sha256")


def _release_chunks(spark, sf):
    d = c.documents(spark, sf).select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("doc_id"),
        "text",
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("source_url"),
    )
    return rl.release_chunks(d)


LICENSES = {f"src{i}": "CC BY 4.0" for i in range(0, 10)} | {"src3": "CC BY-NC-SA 4.0"}
STRIPPED = tuple(f"src{i}" for i in range(10, 20))
_LIC = "CASE WHEN organization = 'src3' THEN 'CC BY-NC-SA 4.0' ELSE 'CC BY 4.0' END"
_FULL = "organization IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')"


@register(
    "release_tiers",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, h AS (SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hh FROM documents)
    SELECT CASE WHEN {_FULL} THEN 'full-text' ELSE 'metadata-only' END AS tier, organization AS org, printf('%s-%s-chunk-%04d', organization, CAST(doc_id AS VARCHAR), chunk_index) AS chunk_id,
      CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, CASE WHEN {_FULL} THEN sha256(text) END AS text_sha256, CASE WHEN {_FULL} THEN {_LIC} END AS license,
      CASE WHEN NOT {_FULL} THEN 'https://' || organization || '.example/' || doc_id END AS source_url, CASE WHEN NOT {_FULL} THEN hh END AS content_sha256 FROM chunks JOIN h USING (doc_id)""",
)
def release_tiers(spark, sf):
    r = rl.tiers(_release_chunks(spark, sf), LICENSES, STRIPPED)
    return r.select("tier", "org", "chunk_id", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"), "license", "source_url", "content_sha256")


@register(
    "release_counts",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS} SELECT CASE WHEN {_FULL} THEN 'full-text' ELSE 'metadata-only' END AS tier, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM chunks GROUP BY 1""",
)
def release_counts(spark, sf):
    return rl.counts(rl.tiers(_release_chunks(spark, sf), LICENSES, STRIPPED))


@register(
    "release_unpack",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS} SELECT organization || '-' || doc_id AS doc_id, count(*) AS n_chunks, min(printf('%s-%s-chunk-%04d', organization, CAST(doc_id AS VARCHAR), chunk_index)) AS metadata_chunk FROM chunks WHERE {_FULL} GROUP BY organization, doc_id""",
)
def release_unpack(spark, sf):
    """What unpacking restores: chunks of the full-text tier and one metadata record per document."""
    chunks, meta = rl.unpack(rl.tiers(_release_chunks(spark, sf), LICENSES, STRIPPED))
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return n.join(meta.select("doc_id", F.col("chunk_id").alias("metadata_chunk")), "doc_id")
