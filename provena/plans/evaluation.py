"""Registered queries: retrieval metrics over the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions.ranking import union_all
from provena.functions.text import entity_codes
from provena.operators import circularity as ci
from provena.operators import evaluate as ev
from provena.operators import prompts as pr
from provena.operators import scope as sc
from provena.operators import search as se
from provena.operators.chunking import window_count
from provena.plans import common as c
from provena.session import cut_lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}
METHODS = ["text", "vector", *[f"hybrid_{k}" for k in se.RRF_K_SWEEP]]


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def ranked_legs(spark, sf, queries=None):
    """Both legs, written once: every method, constant and arm below reads these few rows."""
    q = c.queries(spark, sf) if queries is None else queries
    legs = se.legs(c.corpus_index(spark, sf), q, se.CANDIDATE_POOL, c.inactive(spark, sf), "hybrid")
    both = union_all([leg.select("query_id", "chunk_id", "rank", F.lit(m).alias("leg")) for leg, m in zip(legs, ("text", "vector"))])
    both = cut_lineage(both)
    return [both.where(F.col("leg") == m).drop("leg") for m in ("text", "vector")]


def pools(legs):
    """Candidate lists of every method: (method, query_id, chunk_id, rank)."""
    ks = F.explode(F.array(*[F.lit(k) for k in se.RRF_K_SWEEP]))
    fused = se.fuse([leg.withColumn("rrf_k", ks) for leg in legs], F.col("rrf_k"), se.CANDIDATE_POOL, ("rrf_k", "query_id"))
    hybrid = fused.select(F.concat(F.lit("hybrid_"), F.col("rrf_k").cast("string")).alias("method"), "query_id", "chunk_id", "rank")
    plain = [leg.select(F.lit(m).alias("method"), "query_id", "chunk_id", "rank") for leg, m in zip(legs, ("text", "vector"))]
    return union_all([*plain, hybrid])


def results(spark, sf, legs=None, queries=None):
    """What search returns for every method: boosted pools cut to ten, with organizations."""
    q = c.queries(spark, sf) if queries is None else queries
    p = se.with_doc_id(pools(legs or ranked_legs(spark, sf, q)))
    facts = se.attach(p, q, c.doc_tags(spark, sf), c.ENTITY_KEYWORDS)
    return se.boost(facts, ("method", "query_id")).where(F.col("rank") <= se.TOP_K)


def gold(spark, sf):
    return ev.gold_windows(c.documents(spark, sf), c.queries(spark, sf)).select("query_id", "chunk_id")


def scored(spark, sf):
    return ev.score_questions(c.queries(spark, sf), results(spark, sf), gold(spark, sf), METHODS)


SQL_POOLS = f"""{c.SQL_LEGS},
ks AS (SELECT unnest([1, 10, 30, 60, 100]) AS k),
fz AS (SELECT k, query_id, chunk_id, sum(1.0::DOUBLE / (k + rank)) AS score, min(leg) AS leg, arg_min(rank, leg) AS r0
  FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM text_leg UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vector_leg), ks
  GROUP BY k, query_id, chunk_id),
pools AS (SELECT 'text' AS method, query_id, chunk_id, rank FROM text_leg UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM vector_leg
  UNION ALL SELECT 'hybrid_' || k, query_id, chunk_id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, leg, r0) AS rank FROM fz) WHERE rank <= 50),
results AS (SELECT * FROM (SELECT method, query_id, chunk_id, doc_id, source,
    row_number() OVER (PARTITION BY method, query_id ORDER BY m DESC, rank) AS rank FROM (
    SELECT p.*, d.source, CASE WHEN list_has_any(q.codes, [d.lang, d.source]) THEN 1 ELSE 0 END AS m
    FROM (SELECT *, {c.SQL_DOC_OF} AS doc_id FROM pools) p JOIN queries q USING (query_id) JOIN documents d ON d.doc_id = p.doc_id)) WHERE rank <= 10),
gold AS (SELECT q.query_id, ch.doc_id, ch.chunk_index, ch.chunk_id FROM queries q JOIN chunks ch ON contains(ch.text, q.text)),
acc AS (SELECT query_id, chunk_id, max(s) AS s FROM (
  SELECT query_id, chunk_id, 1 AS s FROM gold
  UNION ALL SELECT query_id, printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), chunk_index + 1), 0 FROM gold
  UNION ALL SELECT query_id, printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), chunk_index - 1), 0 FROM gold WHERE chunk_index > 0) GROUP BY ALL),
per AS (SELECT r.method, r.query_id, min(CASE WHEN a.s = 1 THEN rank END) AS sr, min(CASE WHEN a.s IS NOT NULL THEN rank END) AS rr,
  count(DISTINCT source) AS n_orgs, count(DISTINCT r.doc_id) AS n_docs
  FROM results r LEFT JOIN acc a ON a.query_id = r.query_id AND a.chunk_id = r.chunk_id GROUP BY r.method, r.query_id),
methods AS (SELECT unnest(['text', 'vector', 'hybrid_1', 'hybrid_10', 'hybrid_30', 'hybrid_60', 'hybrid_100']) AS method),
scored AS (SELECT m.method, q.query_id, q.category, CASE WHEN sr IS NULL THEN 0 ELSE 1 END AS hit, coalesce(1.0::DOUBLE / sr, 0) AS rr,
  CASE WHEN per.rr IS NULL THEN 0 ELSE 1 END AS relaxed_hit, coalesce(1.0::DOUBLE / per.rr, 0) AS relaxed_rr,
  CASE WHEN sr <= 3 THEN 1 ELSE 0 END AS h3, CASE WHEN sr <= 5 THEN 1 ELSE 0 END AS h5, coalesce(n_orgs, 0) AS n_orgs, coalesce(n_docs, 0) AS n_docs
  FROM methods m CROSS JOIN queries q LEFT JOIN per ON per.method = m.method AND per.query_id = q.query_id)"""


@register("gold_chunks", f"WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, {c.SQL_QUERIES} SELECT q.query_id, ch.chunk_id FROM queries q JOIN chunks ch ON contains(ch.text, q.text)")
def gold_chunks(spark, sf):
    return gold(spark, sf)


@register(
    "hit_rate_mrr",
    f"""WITH {SQL_POOLS}, cats AS (SELECT unnest(['multi_entity', 'en', 'fr', 'de', 'es', 'general', 'all']) AS category),
    agg AS (SELECT method, coalesce(category, 'all') AS category, count(*) AS n, avg(hit) AS a, avg(rr) AS b, avg(relaxed_hit) AS c, avg(relaxed_rr) AS d,
      avg(h3) AS e, avg(h5) AS f, avg(n_orgs) AS g, avg(n_docs) AS h FROM scored GROUP BY GROUPING SETS ((method, category), (method)))
    SELECT m.method, k.category, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS hit_rate, round(coalesce(b, 0), 6) AS mrr, round(coalesce(c, 0), 6) AS relaxed_hit_rate,
      round(coalesce(d, 0), 6) AS relaxed_mrr, round(coalesce(e, 0), 6) AS hit_rate_at_3, round(coalesce(f, 0), 6) AS hit_rate_at_5,
      round(coalesce(g, 0), 6) AS avg_distinct_orgs, round(coalesce(h, 0), 6) AS avg_distinct_docs
    FROM methods m CROSS JOIN cats k LEFT JOIN agg ON agg.method = m.method AND agg.category = k.category""",
)
def hit_rate_mrr(spark, sf):
    s = ev.summarize(scored(spark, sf), METHODS, c.CATEGORIES)
    return s.select("method", "category", "n", *[F.round(m, 6).alias(m) for m in ev.METRICS])


SQL_BOOT = """ranked AS (SELECT g, id, hit, rr, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM vals),
draws AS (SELECT g, b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 8))::UBIGINT::BIGINT % n AS j, n FROM ranked, (SELECT unnest(range(0, 2000)) AS b)),
means AS (SELECT d.g, b, any_value(d.n) AS n, avg(r.hit) AS hit, avg(r.rr) AS rr FROM draws d JOIN ranked r ON r.g = d.g AND r.i = d.j GROUP BY d.g, b),
long AS (SELECT g, n, 'hit' AS metric, hit AS mean FROM means UNION ALL SELECT g, n, 'rr', rr FROM means),
pos AS (SELECT *, row_number() OVER (PARTITION BY g, metric ORDER BY mean) AS r FROM long),
ci AS (SELECT g, metric, any_value(n) AS n, max(CASE WHEN r = 51 THEN mean END) AS lo, max(CASE WHEN r = 1950 THEN mean END) AS hi FROM pos GROUP BY g, metric)"""


@register(
    "bootstrap_ci",
    f"""WITH {SQL_POOLS}, vals AS (SELECT method AS g, query_id AS id, hit, rr FROM scored), {SQL_BOOT}
    SELECT g AS method, metric, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci""",
)
def bootstrap_ci(spark, sf):
    """95% intervals of hit rate and reciprocal rank of every method."""
    ci_rows = ev.bootstrap_ci(cut_lineage(scored(spark, sf)), ["method"], ["hit", "rr"], "query_id")
    return ci_rows.select("method", "metric", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


SQL_ARMS = f"""{c.SQL_LEGS}, {c.sql_fused('pool')},
marked AS (SELECT p.query_id, p.chunk_id, p.rank, len(q.codes) > 0 AND list_has_any(q.codes, [d.lang, d.source]) AS m
  FROM (SELECT *, {c.SQL_DOC_OF} AS doc_id FROM pool) p JOIN queries q USING (query_id) JOIN documents d ON d.doc_id = p.doc_id),
firing AS (SELECT query_id FROM marked GROUP BY query_id HAVING bool_or(m)),
arms AS (SELECT 'a_baseline' AS arm, query_id, chunk_id, rank FROM pool WHERE rank <= 10
  UNION ALL SELECT 'b_pool_only', query_id, chunk_id, rank FROM pool WHERE rank <= 10
  UNION ALL SELECT 'c_boosted', query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, rank) AS rank FROM marked) WHERE rank <= 10),
gold AS (SELECT q.query_id, ch.chunk_id FROM queries q JOIN chunks ch ON contains(ch.text, q.text)),
sc AS (SELECT x.arm, q.query_id, min(CASE WHEN g.chunk_id IS NOT NULL THEN a.rank END) AS r FROM (SELECT unnest(['a_baseline', 'b_pool_only', 'c_boosted']) AS arm) x CROSS JOIN queries q
  LEFT JOIN arms a ON a.arm = x.arm AND a.query_id = q.query_id LEFT JOIN gold g ON g.query_id = a.query_id AND g.chunk_id = a.chunk_id GROUP BY x.arm, q.query_id),
sr AS (SELECT arm, query_id, CASE WHEN r IS NULL THEN 0 ELSE 1 END AS hit, coalesce(1.0::DOUBLE / r, 0) AS rr FROM sc)"""


@register(
    "rerank_ablation",
    f"""WITH {SQL_ARMS}, both_sets AS (SELECT 'full' AS subset, * FROM sr UNION ALL SELECT 'firing', * FROM sr WHERE query_id IN (FROM firing)),
    wlt AS (SELECT count(*) FILTER (c.rr > b.rr) AS wins, count(*) FILTER (c.rr < b.rr) AS losses, count(*) FILTER (c.rr = b.rr) AS ties
      FROM sr b JOIN sr c ON c.query_id = b.query_id AND b.arm = 'b_pool_only' AND c.arm = 'c_boosted' WHERE b.query_id IN (FROM firing))
    SELECT subset, arm, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr,
      CASE WHEN subset = 'firing' AND arm = 'c_boosted' THEN (SELECT wins FROM wlt) END AS wins, CASE WHEN subset = 'firing' AND arm = 'c_boosted' THEN (SELECT losses FROM wlt) END AS losses,
      CASE WHEN subset = 'firing' AND arm = 'c_boosted' THEN (SELECT ties FROM wlt) END AS ties FROM both_sets GROUP BY subset, arm""",
)
def rerank_ablation(spark, sf):
    """Baseline, deeper pool and boost; the last two must agree wherever the boost does not fire."""
    q = c.queries(spark, sf)
    pool = cut_lineage(se.with_doc_id(se.fuse(ranked_legs(spark, sf, q), 10, se.CANDIDATE_POOL)))
    marked = se.attach(pool, q, c.doc_tags(spark, sf), c.ENTITY_KEYWORDS)
    firing = marked.where((F.size("detected") > 0) & F.arrays_overlap("tags", "detected")).select("query_id").distinct()
    boosted = se.boost(marked)
    arms = {"a_baseline": pool, "b_pool_only": pool, "c_boosted": boosted}
    quiet = [a.where(F.col("rank") <= se.TOP_K).join(firing, "query_id", "left_anti") for a in (pool, boosted)]
    ev.require_same_lists(*quiet)
    rows = union_all(
        [a.select(F.lit(n).alias("method"), "query_id", "chunk_id", "doc_id", F.lit("").alias("organization"), "rank") for n, a in arms.items()]
    )
    s = ev.score_questions(q, rows, gold(spark, sf), list(arms))
    out = ev.ablation(s, firing, list(arms))
    return out.select("subset", "arm", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"), "wins", "losses", "ties")


SQL_DIV = """ds AS (SELECT query_id, list(DISTINCT doc_id) FILTER (method = 'text') AS t, list(DISTINCT doc_id) FILTER (method = 'vector') AS v,
  list(DISTINCT doc_id) FILTER (method = 'hybrid_10') AS h FROM results GROUP BY query_id),
dv AS (SELECT query_id, len(t) AS nt, len(v) AS nv, len(h) AS nh, len(list_intersect(h, v)) / greatest(len(h), 1)::DOUBLE AS ov, len(list_intersect(h, t)) / greatest(len(h), 1)::DOUBLE AS ot
  FROM (SELECT query_id, coalesce(t, []) AS t, coalesce(v, []) AS v, coalesce(h, []) AS h FROM ds))"""


def _diversity(spark, sf):
    r = results(spark, sf).where(F.col("method").isin("text", "vector", "hybrid_10"))
    return ev.diversity(r.withColumn("method", F.regexp_replace("method", "_10$", "")))


@register(
    "diversity_diagnostic",
    f"""WITH {SQL_POOLS}, {SQL_DIV} SELECT query_id, round(ov, 6) AS overlap_vector, round(ot, 6) AS overlap_text,
    CASE WHEN ov > ot THEN 'vector' WHEN ot > ov THEN 'text' ELSE 'tied' END AS closer, CAST(nt - nh AS INTEGER) AS gap, CAST(nt AS INTEGER) AS text_docs,
    CAST(nh AS INTEGER) AS hybrid_docs, CAST(nv AS INTEGER) AS vector_docs FROM dv""",
)
def diversity_diagnostic(spark, sf):
    d = _diversity(spark, sf)
    return d.withColumn("overlap_vector", F.round("overlap_vector", 6)).withColumn("overlap_text", F.round("overlap_text", 6))


@register(
    "diversity_counts",
    f"""WITH {SQL_POOLS}, {SQL_DIV} SELECT count(*) FILTER (ov > ot) AS closer_to_vector, count(*) FILTER (ot > ov) AS closer_to_text, count(*) FILTER (ov = ot) AS tied,
    count(*) AS n, round(count(*) FILTER (ov > ot) / count(*)::DOUBLE, 6) AS share_vector, round(count(*) FILTER (ot > ov) / count(*)::DOUBLE, 6) AS share_text FROM dv""",
)
def diversity_counts(spark, sf):
    d = ev.diversity_counts(_diversity(spark, sf))
    return d.withColumn("share_vector", F.round("share_vector", 6)).withColumn("share_text", F.round("share_text", 6))


@register(
    "largest_gaps",
    f"""WITH {SQL_POOLS}, {SQL_DIV} SELECT query_id, CAST(nt - nh AS INTEGER) AS gap FROM dv ORDER BY nt - nh DESC, query_id LIMIT 5""",
)
def largest_gaps(spark, sf):
    return ev.largest_gaps(_diversity(spark, sf)).select("query_id", "gap")


@register(
    "chunk_category",
    rf"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS} SELECT chunk_id, CASE WHEN len({c.sql_codes('text')}) > 1 THEN 'multi_country'
      WHEN lower(upper(organization)) = 'src3' AND (contains(lower(text), 'ation') OR contains(lower(text), 'ment')) THEN 'src3_methodology' ELSE 'general' END AS category FROM chunks""",
)
def chunk_category(spark, sf):
    ch = c.chunks(spark, sf)
    cat = sc.chunk_category(
        entity_codes("text", c.ENTITY_KEYWORDS), F.upper("source"), F.col("text"), "src3", ("ation", "ment")
    )
    return ch.select("chunk_id", cat.alias("category"))


SQL_CIRC = rf"""q AS (SELECT doc_id, string_split(text, chr(10))[1 + doc_id % len(string_split(text, chr(10)))] AS question,
    CASE WHEN n_chars % 9 = 0 THEN printf('%s-chunk-9999', CAST(doc_id AS VARCHAR)) ELSE printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), (doc_id * 7) % (greatest(0, CAST(ceil((n_chars - 1500) / 750.0) AS BIGINT)) + 1)) END AS correct_chunk_id FROM documents),
  pair AS (SELECT q.doc_id, question, ch.text AS passage FROM q LEFT JOIN chunks ch ON ch.chunk_id = q.correct_chunk_id),
  tk AS (SELECT *, regexp_extract_all(question, '[A-Za-z'']+|[0-9]+') AS qt, regexp_extract_all(passage, '[A-Za-z'']+|[0-9]+') AS pt FROM pair),
  qg AS (SELECT doc_id, i, lower(array_to_string(qt[i:i+3], ' ')) AS g FROM (SELECT doc_id, qt, unnest(range(1, len(qt) - 2)) AS i FROM tk)),
  pgm AS (SELECT DISTINCT doc_id, lower(array_to_string(w, ' ')) AS g FROM (SELECT doc_id, pt[i:i+3] AS w FROM (SELECT doc_id, pt, unnest(range(1, len(pt) - 2)) AS i FROM tk))
    WHERE NOT (list_contains(['web connectivity test','control measurement','freedom on the net','test helper','confirmed anomaly','false positive','false negative','ooni probe','keepiton'], lower(array_to_string(w, ' ')))
      OR len(list_filter(w, lambda t: NOT (list_contains(['a','an','the','of','in','on','for','to','and','or','at','by'], lower(t)) OR regexp_matches(t, '^[A-Z]') OR regexp_matches(t, '^[0-9]+$')))) = 0)),
  hit AS (SELECT qg.doc_id, arg_min(qg.g, qg.i) AS phrase FROM qg JOIN pgm ON pgm.doc_id = qg.doc_id AND pgm.g = qg.g GROUP BY qg.doc_id)"""


def _questions(spark, sf):
    """One question per document: any of its lines, said to come from any of its windows (or from one that is gone)."""
    d = c.documents(spark, sf)
    at = (F.col("doc_id") * 7) % F.greatest(window_count("n_chars"), F.lit(1))
    no = F.when(F.col("n_chars") % 9 == 0, "-chunk-9999").otherwise(F.format_string("-chunk-%04d", at))
    lines = F.split("text", "\n")
    return d.select(
        "doc_id",
        F.element_at(lines, (1 + F.col("doc_id") % F.size(lines)).cast("int")).alias("question"),
        F.concat(F.col("doc_id").cast("string"), no).alias("correct_chunk_id"),
    )


@register(
    "circularity_filter",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, {SQL_CIRC} SELECT pair.doc_id, phrase AS flagged_phrase,
    CASE WHEN passage IS NULL THEN 'unverifiable' WHEN phrase IS NOT NULL THEN 'dropped' ELSE 'kept' END AS outcome FROM pair LEFT JOIN hit USING (doc_id)""",
)
def circularity_filter(spark, sf):
    return ci.check_questions(_questions(spark, sf), c.chunks(spark, sf)).select("doc_id", "flagged_phrase", "outcome")


@register(
    "circularity_counts",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS}, {SQL_CIRC}, o AS (SELECT CASE WHEN passage IS NULL THEN 'unverifiable' WHEN phrase IS NOT NULL THEN 'dropped' ELSE 'kept' END AS o FROM pair LEFT JOIN hit USING (doc_id))
    SELECT count(*) AS total_before, count(*) FILTER (o = 'dropped') AS dropped, count(*) FILTER (o <> 'dropped') AS kept, count(*) FILTER (o = 'unverifiable') AS unverifiable FROM o""",
)
def circularity_counts(spark, sf):
    return ci.filter_counts(ci.check_questions(_questions(spark, sf), c.chunks(spark, sf)))


@register(
    "prompt_assembly",
    f"""WITH {c.SQL_LEGS}, {c.sql_fused()}, top AS (SELECT f.query_id, f.rank, ch.organization, ch.text FROM fused f JOIN chunks ch USING (chunk_id) WHERE rank <= 10),
    b AS (SELECT query_id, string_agg('[' || rank || '] (organization: ' || organization || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS body,
      string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS ex FROM top GROUP BY query_id)
    SELECT q.query_id, sha256('Question: ' || q.text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || body) AS prompt_sha256,
      CAST(length('Question: ' || q.text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || body) AS INTEGER) AS n_chars,
      sha256('Claim:' || chr(10) || q.text || chr(10) || chr(10) || 'Cited excerpt(s):' || chr(10) || chr(10) || ex) AS judge_prompt_sha256
    FROM b JOIN queries q USING (query_id)""",
)
def prompt_assembly(spark, sf):
    """Answer and judge prompts of every benchmark query over its ten fused results."""
    q = c.queries(spark, sf)
    res = cut_lineage(se.fuse(ranked_legs(spark, sf, q), 10, se.TOP_K))
    ch = c.chunks(spark, sf).select("chunk_id", F.col("source").alias("organization"), "text")
    rows = ch.join(c.broadcast_if_small(res.select("query_id", "chunk_id", "rank")), "chunk_id")
    prompts = pr.user_prompts(rows, q)
    excerpts = rows.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("excerpts")
    )
    judge = excerpts.join(q.select("query_id", "text"), "query_id").select(
        "query_id", F.sha2(pr.judge_prompt("text", "excerpts"), 256).alias("judge_prompt_sha256")
    )
    return prompts.select(
        "query_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("n_chars")
    ).join(judge, "query_id")


SQL_PAIRS = f"""{c.SQL_LEGS}, {c.sql_fused()},
top AS (SELECT f.query_id, f.rank, f.chunk_id, ch.organization FROM fused f JOIN chunks ch USING (chunk_id) WHERE f.rank <= 10),
pairs AS (SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM top a JOIN top b ON b.query_id = a.query_id AND a.rank < b.rank AND a.organization <> b.organization)"""


def _pairs(spark, sf):
    q = c.queries(spark, sf)
    res = cut_lineage(se.with_doc_id(se.fuse(ranked_legs(spark, sf, q), 10, se.TOP_K)))
    orgs = c.doc_tags(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "organization")
    return res, ev.cross_source_pairs(orgs.join(c.broadcast_if_small(res), "doc_id"))


@register("cross_source_pairs", f"WITH {SQL_PAIRS} SELECT query_id, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b, chunk_a, chunk_b FROM pairs")
def cross_source_pairs(spark, sf):
    return _pairs(spark, sf)[1].select("query_id", "rank_a", "rank_b", "chunk_a", "chunk_b")


@register(
    "pair_budget",
    f"""WITH RECURSIVE {SQL_PAIRS}, ev AS (SELECT query_id, n_retrieved, n_pairs, row_number() OVER (ORDER BY query_id) AS i, count(*) OVER () AS total FROM (
      SELECT t.query_id, count(*) AS n_retrieved, (SELECT count(*) FROM pairs p WHERE p.query_id = t.query_id) AS n_pairs FROM top t GROUP BY t.query_id)),
    walk AS (SELECT query_id, i, total, n_retrieved, n_pairs, 50::BIGINT AS left_, greatest(1, 50 // total) AS cap, least(greatest(1, 50 // total), n_pairs) AS used FROM ev WHERE i = 1
      UNION ALL SELECT e.query_id, e.i, e.total, e.n_retrieved, e.n_pairs, w.left_ - w.used, greatest(1, (w.left_ - w.used) // (e.total - e.i + 1)), least(greatest(1, (w.left_ - w.used) // (e.total - e.i + 1)), e.n_pairs)
      FROM walk w JOIN ev e ON e.i = w.i + 1 WHERE w.left_ - w.used > 0)
    SELECT w.query_id, w.n_retrieved, w.n_pairs, CAST(cap AS INTEGER) AS cap, CAST(used AS INTEGER) AS n_checked, CAST(left_ AS INTEGER) AS remaining,
      (SELECT count(*) FROM (SELECT *, row_number() OVER (ORDER BY rank_a, rank_b) AS pos FROM pairs p WHERE p.query_id = w.query_id) x WHERE pos <= used AND (rank_a + rank_b) % 5 = 0) AS n_survivors FROM walk w""",
)
def pair_budget(spark, sf):
    """Fifty checks spread over the events in order; a checked pair survives where a verdict says it disagrees."""
    res, pairs = _pairs(spark, sf)
    pairs = cut_lineage(pairs)
    n_ret = res.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    n_pairs = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    per = n_ret.join(n_pairs, "query_id", "left").na.fill(0, ["n_pairs"])
    spent = ev.spend_budget(per.select("query_id", "n_pairs"), 50)
    w = ev.Window.partitionBy("query_id").orderBy("rank_a", "rank_b")
    verdicts = pairs.withColumn("pos", F.row_number().over(w)).join(spent.select("query_id", "n_checked"), "query_id").where("pos <= n_checked")
    survivors = verdicts.groupBy("query_id").agg(F.count_if((F.col("rank_a") + F.col("rank_b")) % 5 == 0).alias("n_survivors"))
    return spent.join(n_ret, "query_id").join(survivors, "query_id", "left").na.fill(0, ["n_survivors"])


SQL_RW = f"""rw AS (SELECT item_id, text AS raw, CASE length(text) % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'the ' || text END AS rewritten FROM benchmark),
queries AS (SELECT query_id, text, codes, 'all' AS category FROM (SELECT item_id * 2 AS query_id, raw AS text, {c.sql_codes('raw')} AS codes FROM rw
  UNION ALL SELECT item_id * 2 + 1, coalesce(nullif({c.sql_strip('rewritten')}, ''), raw), {c.sql_codes("coalesce(nullif(" + c.sql_strip('rewritten') + ", ''), raw)")} FROM rw))"""


@register(
    "rewrite_delta",
    "WITH " + SQL_RW + ", " + SQL_POOLS.replace(c.SQL_QUERIES + ",\n", "").replace(
        "gold AS (SELECT q.query_id, ch.doc_id, ch.chunk_index, ch.chunk_id FROM queries q JOIN chunks ch ON contains(ch.text, q.text))",
        "gold0 AS (SELECT b.item_id, ch.doc_id, ch.chunk_index, ch.chunk_id FROM benchmark b JOIN chunks ch ON contains(ch.text, b.text)), gold AS (SELECT item_id * 2 + v AS query_id, doc_id, chunk_index, chunk_id FROM gold0, (SELECT unnest([0, 1]) AS v))",
    )
    + f""", vals AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'raw' ELSE 'rewritten' END AS g, query_id // 2 AS id, hit, rr FROM scored WHERE method = 'hybrid_10'), {SQL_BOOT},
    av AS (SELECT g, 'hit' AS metric, avg(hit) AS v FROM vals GROUP BY g UNION ALL SELECT g, 'rr', avg(rr) FROM vals GROUP BY g)
    SELECT a.metric, round(a.v, 6) AS raw, round(b.v, 6) AS rewritten, round(b.v - a.v, 6) AS delta, x.n, x.lo <= y.hi AND y.lo <= x.hi AS overlap
    FROM av a JOIN av b ON b.metric = a.metric AND b.g = 'rewritten' JOIN ci x ON x.g = 'raw' AND x.metric = a.metric JOIN ci y ON y.g = 'rewritten' AND y.metric = a.metric WHERE a.g = 'raw'""",
)
def rewrite_delta(spark, sf):
    """Hybrid search with raw and rewritten queries in one batch: change of each metric and interval overlap."""
    b = c.table(spark, sf, "benchmark")
    cache = b.select(
        F.col("text").alias("query"),
        F.when(F.length("text") % 3 == 0, F.lit(" ")).when(F.length("text") % 3 == 1, F.concat(F.lit("the "), "text")).alias("rewritten"),
    ).where("rewritten is not null").groupBy("query").agg(F.first("rewritten").alias("rewritten"))
    j = b.select("item_id", F.col("text").alias("query")).join(cache, "query", "left")
    rw = sc.rewritten_or_original(F.col("query"), F.col("rewritten"))
    variants = j.select(
        F.explode(
            F.array(
                F.struct((F.col("item_id") * 2).alias("query_id"), F.col("query").alias("text")),
                F.struct((F.col("item_id") * 2 + 1).alias("query_id"), rw.alias("text")),
            )
        ).alias("v")
    ).select("v.query_id", "v.text", F.lit("all").alias("category"))
    g = gold(spark, sf).select((F.col("query_id") * 2).alias("a"), (F.col("query_id") * 2 + 1).alias("b"), "chunk_id")
    g = g.select(F.explode(F.array("a", "b")).alias("query_id"), "chunk_id")
    res = results(spark, sf, queries=variants).where("method = 'hybrid_10'")
    s = ev.score_questions(variants, res, g, ["hybrid_10"]).select(
        F.when(F.col("query_id") % 2 == 0, "raw").otherwise("rewritten").alias("variant"),
        F.floor(F.col("query_id") / 2).alias("item_id"), "hit", "rr",
    )
    s = cut_lineage(s)
    intervals = ev.bootstrap_ci(s, ["variant"], ["hit", "rr"], "item_id")
    means = s.groupBy("variant").agg(F.avg("hit").alias("hit"), F.avg("rr").alias("rr"))
    long = means.select("variant", F.explode(F.array(F.struct(F.lit("hit").alias("metric"), F.col("hit").alias("v")), F.struct(F.lit("rr").alias("metric"), F.col("rr").alias("v")))).alias("m")).select("variant", "m.metric", "m.v")
    t = long.join(intervals, ["variant", "metric"])
    raw, new = (
        t.where(F.col("variant") == v).select("metric", F.col("v").alias(v), F.col("lo").alias(f"{v}_lo"), F.col("hi").alias(f"{v}_hi"), F.col("n").alias(f"{v}_n"))
        for v in ("raw", "rewritten")
    )
    return raw.join(new, "metric").select(
        "metric", F.round("raw", 6).alias("raw"), F.round("rewritten", 6).alias("rewritten"), F.round(F.col("rewritten") - F.col("raw"), 6).alias("delta"),
        F.col("raw_n").alias("n"), ev.intervals_overlap(F.col("raw_lo"), F.col("raw_hi"), F.col("rewritten_lo"), F.col("rewritten_hi")).alias("overlap"),
    )
