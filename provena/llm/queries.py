"""The registered queries of the training-data operators on the driver tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import language_id, pii, quality_forest, toxicity, url_filters
from provena.llm.chat import ChatTemplate
from provena.llm.collocations import Collocations
from provena.llm.common import held_out, table
from provena.llm.decontamination import Decontamination
from provena.llm.embedding_dedup import CosineLinks
from provena.llm.line_dedup import LineDedup
from provena.llm.mixing import Mix
from provena.llm.ngram_join import JaccardJoin
from provena.llm.spelling import SpellingVariants


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = toxicity.train(docs.where(~out), table(spark, sf, "labels").where(~out))
    return model.score(docs).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every page. The URLs that a rule decides are the labelled ones."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    _, verdict = url_filters.rule_of(*url_filters.parts(F.coalesce("url", F.lit(""))))
    labelled = pages.withColumn("blocked", (verdict == "block").cast("int"))
    out = url_filters.judge(pages, url_filters.train(labelled))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, and whether the prediction is accepted."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    model = language_id.train(docs.where(~out).select("text", "lang"))
    return model.predict(docs.drop("lang")).select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted")


def op4_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector: links at a cosine of 0.98 within a label."""
    out = CosineLinks().classes(table(spark, sf, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, the text without repeated passages, and the number of words removed, of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return LineDedup().clean(docs).select("doc_id", "text", "removed_words")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document in a mix of all sources weighed 5, 2, 1, 5, ..."""
    return Mix().taken(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, item_id, cosine and overlap of every document and benchmark item that it holds, verbatim or reworded."""
    out = Decontamination().matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.withColumnRenamed("key", "doc_id")


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of all base spans, all spans, and the number of added ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def digest(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = pii.train(docs).spans(docs)
    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select(
        F.col("key").alias("doc_id"), *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: links at a Jaccard similarity of 0.75 of 5-word shingles."""
    out = JaccardJoin().classes(table(spark, sf, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_chat(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, part, n_turns, n_copies and the rendered chat of every conversation that is no prefix of another."""
    return ChatTemplate().render(table(spark, sf, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    variants = SpellingVariants()
    return variants.variants(variants.vocabulary(table(spark, sf, "documents")))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's 2000 best phrases."""
    return Collocations().mine(table(spark, sf, "documents"))


def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, the counts of the rules, base_failed and kept of every document, and its anomaly score."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged = quality_forest.train(docs, table(spark, sf, "labels")).judge(docs)
    failed = quality_forest.base_failed()
    return judged.select(
        F.col("key").alias("doc_id"), *quality_forest.STATS, failed.alias("base_failed"), (~failed & F.col("typical")).alias("kept"), "anomaly"
    )


QUERIES = {"op1_toxicity": op1_toxicity, "op2_url_filters": op2_url_filters, "op3_language_id": op3_language_id, "op4_embedding_dedup": op4_embedding_dedup, "op5_line_dedup": op5_line_dedup, "op6_mixing": op6_mixing, "op7_decontamination": op7_decontamination, "op8_pii": op8_pii, "op9_ngram_join": op9_ngram_join, "op10_chat": op10_chat, "op11_spelling_variants": op11_spelling_variants, "op12_collocations": op12_collocations, "op13_quality_rules": op13_quality_rules}
SQL: dict[str, str] = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, least(coalesce(c.least, e.vec_id), e.vec_id) AS component_id,
       e.vec_id = least(coalesce(c.least, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)""",
    "op12_collocations": """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
           FROM (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE CAST(100 AS HUGEINT) * i.a >= CAST(80 AS HUGEINT) * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, j, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
         JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least ANTI JOIN gone USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op10_chat": """
WITH c AS (
  SELECT conv_id, list(struct_pack(t := turn, r := role, x := text) ORDER BY turn) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id),
k AS (SELECT conv_id, len(turns) AS n, list_transform(turns, lambda t: struct_pack(r := t.r, x := t.x)) AS k,
             list_reduce(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.r, '') || chr(10) || coalesce(t.x, '') || '<|im_end|>' || chr(10)),
                         lambda a, b: a || b) AS chat FROM c),
own AS (SELECT min(conv_id) AS conv_id, n, k, count(*) AS n_copies, any_value(chat) AS chat FROM k GROUP BY n, k),
inner_ AS (SELECT DISTINCT k[1:i] AS k FROM k, unnest(range(1, n)) AS u(i))
SELECT conv_id, CAST(0 AS BIGINT) AS part, n AS n_turns, n_copies, chat FROM own
WHERE k NOT IN (SELECT k FROM inner_)""",
}
