"""Registered queries: citations, claims, verdicts and answer quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions.text import bind
from provena.operators import citations as cit
from provena.operators.chunking import window_count
from provena.operators import claims as cl
from provena.operators import prompts as pr
from provena.operators import review as rv
from provena.operators import scope as sc
from provena.plans import common as c

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def answers(spark, sf):
    """One answer per document: its lines as paragraphs, four of five closing with a marker 0..11."""
    d = c.documents(spark, sf)
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when(i % 5 == 4, s).otherwise(F.concat(s, F.lit(" ["), (i % 12).cast("string"), F.lit("]"))),
    )
    return d.select(
        F.col("doc_id").alias("question_id"),
        F.col("lang").alias("category"),
        F.array_join(lines, "\n\n").alias("answer_markdown"),
    )


def retrieved(spark, sf):
    """Ten numbered passages per question: windows and documents spread over the corpus by id arithmetic."""
    d = c.table(spark, sf, "documents").select("doc_id")
    n = c.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = F.explode(F.sequence(F.lit(1), F.lit(10)))
    r = d.select(F.col("doc_id").alias("question_id"), rank.alias("rank"), n.alias("n")).select(
        "question_id", "rank", ((F.col("question_id") * 31 + F.col("rank") * 17) % F.col("n")).alias("doc_id")
    )
    windows = c.table(spark, sf, "documents").select("doc_id", F.greatest(window_count("n_chars"), F.lit(1)).alias("w"))
    r = r.join(windows, "doc_id").withColumn("i", (F.col("question_id") * 7 + F.col("rank")) % F.col("w"))
    pages = F.when(F.col("doc_id") % 3 == 1, F.array(F.col("rank"))).when(
        F.col("doc_id") % 3 == 2, F.array(F.col("rank"), F.col("rank") + 1)
    )
    return r.select(
        "question_id",
        "rank",
        F.format_string("%s-chunk-%04d", F.col("doc_id").cast("string"), "i").alias("chunk_id"),
        "doc_id",
        pages.alias("pages"),
        F.when(F.col("rank") % 4 != 0, F.lit(1.0) / (10 + F.col("rank"))).alias("score"),
    )


def parsed(spark, sf):
    r = cit.retrieved_lists(retrieved(spark, sf))
    return cit.parse_citations(answers(spark, sf).join(r, "question_id", "left"))


def meta(spark, sf):
    """Declared metadata, missing for every seventh document."""
    d = c.table(spark, sf, "documents").where("doc_id % 7 <> 0")
    return d.select(
        "doc_id",
        F.col("source").alias("organization"),
        F.concat(F.lit("Report "), F.col("doc_id").cast("string")).alias("title"),
        F.format_string("%d-%02d-15", 2020 + F.col("n_chars") % 8, 1 + F.col("doc_id") % 12).alias("publication_date"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
    )


SQL_ANS = r"""ans AS (SELECT doc_id AS question_id, lang AS category, array_to_string(list_transform(string_split(text, chr(10)),
    lambda s, i: CASE WHEN (i - 1) % 5 = 4 THEN s ELSE s || ' [' || ((i - 1) % 12) || ']' END), chr(10) || chr(10)) AS answer FROM documents),
ret AS (SELECT question_id, rank, doc_id, printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), i) AS chunk_id, i,
    CASE doc_id % 3 WHEN 1 THEN [rank] WHEN 2 THEN [rank, rank + 1] END AS pages, CASE WHEN rank % 4 <> 0 THEN 1.0::DOUBLE / (10 + rank) END AS score FROM (
    SELECT r.*, (question_id * 7 + rank) % (greatest(0, CAST(ceil((w.n_chars - 1500) / 750.0) AS BIGINT)) + 1) AS i FROM (
      SELECT doc_id AS question_id, rank, (doc_id * 31 + rank * 17) % (SELECT count(*) FROM documents) AS doc_id FROM documents, (SELECT unnest(range(1, 11)) AS rank)) r
    JOIN documents w ON w.doc_id = r.doc_id)),
mk AS (SELECT question_id, unnest(ms)::BIGINT AS m, unnest(range(1, len(ms) + 1)) AS pos FROM (SELECT question_id, regexp_extract_all(answer, '\[(\d+)\]', 1) AS ms FROM ans)),
cites AS (SELECT DISTINCT mk.question_id, m AS marker, ret.chunk_id, ret.doc_id, ret.pages, ret.score FROM mk JOIN ret ON ret.question_id = mk.question_id AND ret.rank = mk.m),
inv AS (SELECT question_id, m, min(pos) AS p FROM mk WHERE m < 1 OR m > 10 GROUP BY question_id, m),
meta AS (SELECT doc_id, source AS organization, 'Report ' || doc_id AS title, printf('%d-%02d-15', 2020 + n_chars % 8, 1 + doc_id % 12) AS publication_date,
    'https://' || source || '.example/' || doc_id AS url FROM documents WHERE doc_id % 7 <> 0),
paras AS (SELECT question_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT question_id, string_split(answer, chr(10) || chr(10)) AS ps FROM ans)),
unsup AS (SELECT question_id, STRIPPED AS p, i FROM paras WHERE STRIPPED <> '' AND NOT regexp_matches(p, '\[\d+\]'))""".replace(
    "STRIPPED", c.sql_strip("p")
)


@register(
    "citation_parse",
    f"""WITH {SQL_ANS} SELECT a.question_id, coalesce((SELECT string_agg(marker || ':' || chunk_id, ',' ORDER BY marker) FROM cites x WHERE x.question_id = a.question_id), '') AS citations,
      coalesce((SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY p) FROM inv x WHERE x.question_id = a.question_id), '') AS invalid_markers,
      (SELECT CAST(count(*) AS INTEGER) FROM unsup x WHERE x.question_id = a.question_id) AS n_unsupported,
      sha256(coalesce((SELECT string_agg(p, '|' ORDER BY i) FROM unsup x WHERE x.question_id = a.question_id), '')) AS unsupported_sha256 FROM ans a""",
)
def citation_parse(spark, sf):
    p = parsed(spark, sf)
    return p.select(
        "question_id",
        F.array_join(F.transform("citations", lambda x: F.concat_ws(":", x["marker"], x["chunk_id"])), ",").alias("citations"),
        F.array_join("invalid_markers", ",").alias("invalid_markers"),
        F.size("unsupported_paragraphs").alias("n_unsupported"),
        F.sha2(F.array_join("unsupported_paragraphs", "|"), 256).alias("unsupported_sha256"),
    )


@register(
    "source_lines",
    f"""WITH {SQL_ANS}, l AS (SELECT question_id, marker, CASE WHEN m.doc_id IS NULL THEN '[' || marker || '] ' || x.doc_id || ' (metadata unavailable), chunk ' || chunk_id || '.'
      ELSE '[' || marker || '] ' || organization || ', "' || title || '" (' || publication_date || ')' || CASE WHEN pages IS NULL THEN '' WHEN len(pages) = 1 THEN ', p. ' || pages[1]
      ELSE ', pp. ' || pages[1] || '-' || pages[-1] END || '. ' || url END AS line FROM cites x LEFT JOIN meta m ON m.doc_id = x.doc_id)
    SELECT question_id, string_agg(line, chr(10) ORDER BY marker) AS sources FROM l GROUP BY question_id""",
)
def source_lines(spark, sf):
    return cit.source_lines(cit.citation_rows(parsed(spark, sf)), meta(spark, sf))


@register(
    "sourcing_footer",
    f"""WITH {SQL_ANS}, s AS (SELECT a.question_id, count(DISTINCT x.doc_id) AS nd, count(DISTINCT m.organization) AS n_o, min(m.organization) AS org, min(left(publication_date, 4)) AS y0, max(left(publication_date, 4)) AS y1
      FROM ans a LEFT JOIN cites x USING (question_id) LEFT JOIN meta m ON m.doc_id = x.doc_id GROUP BY a.question_id),
    y AS (SELECT *, CASE WHEN y0 IS NULL THEN 'date unknown' WHEN y0 = y1 THEN y0 ELSE y0 || '-' || y1 END AS yr FROM s)
    SELECT question_id, n_o AS distinct_orgs, nd AS distinct_docs, CASE WHEN nd = 0 THEN 'Sourcing: no citations were produced for this answer.'
      WHEN nd = 1 THEN 'Sourcing: this answer cites a single document (from ' || coalesce(org, 'an unknown organization') || '). No independent corroboration was found among the retrieved evidence for this question.'
      WHEN n_o = 1 THEN 'Sourcing: all cited evidence comes from one organization (' || org || '), across ' || nd || ' reports (' || yr || ').'
      ELSE 'Sourcing: this answer cites ' || nd || ' documents from ' || n_o || ' organizations (' || yr || ').' END AS footer,
      CASE WHEN nd = 0 THEN 'none' WHEN nd = 1 THEN 'thin' WHEN n_o = 1 THEN 'single_org' ELSE 'broad' END AS sourcing_status FROM y""",
)
def sourcing_footer(spark, sf):
    p = parsed(spark, sf)
    return cit.sourcing(p, cit.citation_rows(p), meta(spark, sf))


@register(
    "interaction_facts",
    f"""WITH {SQL_ANS} SELECT a.question_id, (SELECT CAST(count(*) AS INTEGER) FROM cites x WHERE x.question_id = a.question_id) AS citation_count,
      (SELECT CAST(count(*) AS INTEGER) FROM inv x WHERE x.question_id = a.question_id) AS invalid_marker_count, (SELECT CAST(count(*) AS INTEGER) FROM unsup x WHERE x.question_id = a.question_id) AS unsupported_paragraph_count,
      8 AS n_scores, (SELECT string_agg(DISTINCT organization, ',' ORDER BY organization) FROM cites x JOIN meta m ON m.doc_id = x.doc_id WHERE x.question_id = a.question_id) AS source_orgs,
      (SELECT string_agg(marker || ':' || coalesce(organization, '-') || ':' || coalesce(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY marker) FROM cites x LEFT JOIN meta m ON m.doc_id = x.doc_id WHERE x.question_id = a.question_id) AS summary
    FROM ans a""",
)
def interaction_facts(spark, sf):
    f = cit.interaction_facts(parsed(spark, sf), meta(spark, sf))
    item = lambda x: F.concat_ws(
        ":", x["marker"], F.coalesce(x["org"], F.lit("-")), F.coalesce(F.round(x["score"] * 1000000).cast("bigint").cast("string"), F.lit("-"))
    )
    return f.select(
        "question_id", "citation_count", "invalid_marker_count", "unsupported_paragraph_count",
        F.size("retrieval_scores").alias("n_scores"),
        F.when(F.size("source_orgs") > 0, F.array_join("source_orgs", ",")).alias("source_orgs"),
        F.array_join(F.transform("citations_summary", item), ",").alias("summary"),
    )


SQL_CLAIMS = rf"""masked AS (SELECT question_id, category, regexp_replace(regexp_replace(answer, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g') AS t FROM ans),
found AS (SELECT *, regexp_extract_all(t, '[^.!?]*[.!?]+(?:{c.WS}*\[\d+\])*') AS f FROM masked),
sents AS (SELECT question_id, category, unnest(fs) AS s, unnest(range(1, len(fs) + 1)) AS si FROM (
  SELECT question_id, category, list_append(f, substring(t, CAST(coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) AS BIGINT) + 1)) AS fs FROM found)),
cm AS (SELECT *, list_filter(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda m: m::BIGINT), lambda m: m BETWEEN 1 AND 10) AS ms FROM (
  SELECT question_id, category, si, {c.sql_strip("replace(s, chr(1), '.')")} AS s FROM sents)),
claims AS (SELECT question_id, category, s AS claim_text, row_number() OVER (PARTITION BY question_id ORDER BY si) - 1 AS ci,
  list_filter(ms, lambda m, i: list_position(ms, m) = i) AS markers FROM cm WHERE len(ms) > 0 AND s <> ''),
jids AS (SELECT *, printf('%s::claim%03d', CAST(question_id AS VARCHAR), ci) AS judgment_id FROM claims),
jv AS (SELECT *, CASE WHEN substr(md5(judgment_id), 1, 1) BETWEEN '0' AND '9' THEN 'supported' WHEN substr(md5(judgment_id), 1, 1) BETWEEN 'a' AND 'c' THEN 'partial' ELSE 'unsupported' END AS verdict FROM jids)"""


def claims(spark, sf):
    x = cl.extract_claims(parsed(spark, sf))
    return x.withColumn("judgment_id", cl.judgment_id(F.col("question_id"), F.col("claim_index")))


def stand_in_verdict(jid):
    """A verdict that depends on the judgment id alone, where no model is at hand."""
    h = F.substring(F.md5(jid), 1, 1)
    return F.when(h.between("0", "9"), "supported").when(h.between("a", "c"), "partial").otherwise("unsupported")


def judgments(spark, sf):
    return claims(spark, sf).withColumn("verdict", stand_in_verdict("judgment_id"))


@register(
    "claim_extract",
    f"""WITH {SQL_ANS}, {SQL_CLAIMS}, ex AS (SELECT judgment_id, string_agg(t, '|' ORDER BY mp) AS texts, count(*) AS n FROM (
        SELECT judgment_id, min(mp) AS mp, any_value(substring(d.text, ret.i * 750 + 1, 1500)) AS t FROM (SELECT judgment_id, question_id, unnest(markers) AS m, unnest(range(1, len(markers) + 1)) AS mp FROM jids) j
        JOIN ret ON ret.question_id = j.question_id AND ret.rank = j.m JOIN documents d ON d.doc_id = ret.doc_id AND d.n_chars > 0 GROUP BY judgment_id, ret.chunk_id) GROUP BY judgment_id)
    SELECT judgment_id, claim_text, array_to_string(markers, ',') AS markers, CAST(coalesce(n, 0) AS INTEGER) AS n_excerpts, sha256(coalesce(texts, '')) AS excerpts_sha256 FROM jids LEFT JOIN ex USING (judgment_id)""",
)
def claim_extract(spark, sf):
    """Claims of every answer with the text of the windows they cite."""
    texts = c.chunks(spark, sf).select("chunk_id", "text")
    x = cl.with_chunk_texts(claims(spark, sf).select("judgment_id", "claim_text", "markers", "citations"), texts)
    return x.select(
        "judgment_id", "claim_text", F.array_join("markers", ",").alias("markers"), F.size("cited_chunk_texts").alias("n_excerpts"),
        F.sha2(F.array_join("cited_chunk_texts", "|"), 256).alias("excerpts_sha256"),
    )


@register(
    "citation_precision",
    f"""WITH {SQL_ANS}, {SQL_CLAIMS} SELECT coalesce(category, 'overall') AS category, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial,
      count(*) FILTER (verdict = 'unsupported') AS unsupported, round(count(*) FILTER (verdict = 'supported') / count(*)::DOUBLE, 6) AS precision FROM jv GROUP BY GROUPING SETS ((category), ())""",
)
def citation_precision(spark, sf):
    return rv.citation_precision(judgments(spark, sf)).withColumn("precision", F.round("precision", 6))


@register(
    "mechanical_counts",
    f"""WITH {SQL_ANS}, k AS (SELECT a.category, (SELECT count(*) FROM inv x WHERE x.question_id = a.question_id) AS i, (SELECT count(*) FROM unsup x WHERE x.question_id = a.question_id) AS u FROM ans a)
    SELECT coalesce(category, 'overall') AS category, CAST(sum(i) AS BIGINT) AS invalid_markers, CAST(sum(u) AS BIGINT) AS unsupported_paragraphs FROM k GROUP BY GROUPING SETS ((category), ())""",
)
def mechanical_counts(spark, sf):
    return rv.mechanical_counts(parsed(spark, sf))


SQL_TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  AND u.role = 'user' AND a.role = 'assistant')"""


def turns(spark, sf):
    """A user turn and the assistant turn that answers it."""
    t = c.table(spark, sf, "conversations")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text"))
    return u.join(a, ["conv_id", "turn"])


SQL_SCOPE = r"""sq AS (SELECT conv_id, turn,
  user_text || CASE length(user_text) % 7 WHEN 0 THEN ' Nigeria and Niger' WHEN 1 THEN ' Somalia, Mali and drc or Congo' WHEN 2 THEN ' Which organizations are they?' WHEN 3 THEN ' What years?' WHEN 4 THEN ' nigerian' ELSE '' END AS q,
  assistant_text || CASE length(assistant_text) % 3 WHEN 0 THEN ' [1]' WHEN 1 THEN ' OONI, Access Now, CIPESA, Freedom House 2022 to 2026' ELSE '' END AS a FROM turns),
names AS (SELECT *, list_distinct(list_filter([NAMES], lambda x: x IS NOT NULL)) AS dn, list_filter([NAMES], lambda x: x IS NOT NULL) AS raw_names FROM sq),
nm AS (SELECT conv_id, turn, q, a, list_filter(raw_names, lambda x, i: list_position(raw_names, x) = i) AS n FROM names),
disc AS (SELECT *, CASE WHEN len(n) = 1 THEN 'Note: ' || n[1] || ' is' || 'REST' WHEN len(n) > 1 THEN 'Note: ' || array_to_string(n[1:-2], ', ') || ' and ' || n[-1] || ' are' || 'REST' END AS d FROM nm)""".replace(
    "NAMES",
    ", ".join(f"CASE WHEN regexp_matches(lower(q), '(^|[^\\p{{L}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{v}' END" for k, v in sc.OUT_OF_SCOPE.items()),
).replace("REST", sc.DISCLOSURE_REST.replace("'", "''"))


def scope_inputs(spark, sf):
    t = turns(spark, sf)
    n = F.length("user_text") % 7
    extra = (
        F.when(n == 0, " Nigeria and Niger").when(n == 1, " Somalia, Mali and drc or Congo").when(n == 2, " Which organizations are they?")
        .when(n == 3, " What years?").when(n == 4, " nigerian").otherwise("")
    )
    m = F.length("assistant_text") % 3
    tail = F.when(m == 0, " [1]").when(m == 1, " OONI, Access Now, CIPESA, Freedom House 2022 to 2026").otherwise("")
    return t.select("conv_id", "turn", F.concat("user_text", extra).alias("q"), F.concat("assistant_text", tail).alias("a"))


_ORGS_IN = " AND ".join(f"contains(lower({{0}}), '{o.lower()}')" for o in sc.ORGS)
_OC, _TC = sc.ORG_CLAUSE.replace("'", "''"), sc.TIME_CLAUSE.replace("'", "''")
_ORG_META = " OR ".join(f"contains(lower(q), '{p}')" for p in sc.ORG_META)
_TIME_META = " OR ".join(f"contains(lower(q), '{p}')" for p in sc.TIME_META)


@register(
    "scope_detection",
    f"""WITH {SQL_TURNS}, {SQL_SCOPE}, s1 AS (SELECT *, CASE WHEN len(n) > 0 AND contains(a, '[1]') THEN d || chr(10) || chr(10) || a ELSE a END AS x FROM disc),
    s2 AS (SELECT *, CASE WHEN ({_ORG_META}) AND NOT ({_ORGS_IN.format('x')}) THEN x || chr(10) || chr(10) || '{_OC}' ELSE x END AS y FROM s1),
    s3 AS (SELECT *, CASE WHEN ({_TIME_META}) AND NOT (contains(y, '2022') AND contains(y, '2026')) THEN y || chr(10) || chr(10) || '{_TC}' ELSE y END AS z FROM s2)
    SELECT conv_id, turn, array_to_string(n, '; ') AS names, d AS disclosure, ({_ORG_META}) AND NOT ({_ORGS_IN.format('a')}) AS needs_org_fact,
      ({_TIME_META}) AND NOT (contains(a, '2022') AND contains(a, '2026')) AS needs_time_fact, sha256(z) AS final_sha256 FROM s3""",
)
def scope_detection(spark, sf):
    """Countries outside the scope named in each question, the disclosure and the final answer."""
    s = scope_inputs(spark, sf)
    names = sc.out_of_scope("q")
    cited = F.contains("a", F.lit("[1]")).cast("int")
    return s.select(
        "conv_id", "turn", F.array_join(names, "; ").alias("names"), bind(names, sc.disclosure).alias("disclosure"),
        sc.needs_org_fact("q", "a").alias("needs_org_fact"), sc.needs_time_fact("q", "a").alias("needs_time_fact"),
        F.sha2(sc.final_answer("q", "a", cited), 256).alias("final_sha256"),
    )


_DECL = " OR ".join("contains(lower(a), '" + p.replace("'", "''") + "')" for p in sc.DECLINE_PHRASES)


@register(
    "decline_heuristic",
    f"""WITH {SQL_TURNS}, x AS (SELECT conv_id, turn, assistant_text || CASE length(assistant_text) % 5 WHEN 0 THEN ' The excerpts do NOT contain this.' WHEN 1 THEN ' I can''t answer that [2].' WHEN 2 THEN ' It is OUTSIDE the corpus' ELSE '' END AS a FROM turns)
    SELECT conv_id, turn, {_DECL} AS declined, CAST(len(list_distinct(regexp_extract_all(a, '\\[(\\d+)\\]', 1))) AS INTEGER) AS n_citations FROM x""",
)
def decline_heuristic(spark, sf):
    t = turns(spark, sf)
    n = F.length("assistant_text") % 5
    tail = F.when(n == 0, " The excerpts do NOT contain this.").when(n == 1, " I can't answer that [2].").when(n == 2, " It is OUTSIDE the corpus").otherwise("")
    x = t.select("conv_id", "turn", F.concat("assistant_text", tail).alias("a"))
    return x.select("conv_id", "turn", sc.declines("a").alias("declined"), F.size(F.array_distinct(cit.markers("a"))).alias("n_citations"))


SQL_RULES = r"""rb AS (SELECT conv_id, turn, conv_id % 25 + 1 AS qid, user_text || CASE length(user_text) % 4 WHEN 0 THEN ' Nigeria and Mali' ELSE '' END AS question,
    assistant_text || CASE length(assistant_text) % 2 WHEN 0 THEN ' Kenya [1]' ELSE '' END || CASE length(assistant_text) % 7 WHEN 0 THEN ' [99]' ELSE '' END
      || CASE length(assistant_text) % 3 WHEN 0 THEN ' This corpus does not cover it; I can''t say.' WHEN 1 THEN ' Egypt and Sudan.' ELSE '' END AS a0 FROM turns),
  q2 AS (SELECT conv_id, turn, qid, question AS q, CASE WHEN contains(question, 'Nigeria and Mali') AND length(a0) % 5 <> 0 THEN 'Note: Nigeria and Mali are' || 'REST' || chr(10) || chr(10) || a0 ELSE a0 END AS a FROM rb),
  rl AS (SELECT *, lower(a) AS l, contains(a, '[1]') AS cited, NOT contains(a, '[99]') AS clean,
    list_filter([LEAKS], lambda x: x IS NOT NULL) AS leaks,
    contains(q, 'Nigeria and Mali') AND contains(a, 'Note: Nigeria and Mali are' || 'REST') AS disclosed, RULEDECL AS decl FROM q2),
  ok AS (SELECT *, CASE WHEN qid <= 10 THEN cited AND clean AND cited WHEN qid <= 15 THEN len(leaks) = 0 WHEN qid = 18 THEN cited AND contains(l, 'kenya') AND (disclosed OR decl) AND clean
    WHEN qid <= 20 THEN clean AND ((decl AND NOT cited) OR (cited AND disclosed)) WHEN qid = 21 THEN (REFUSE) AND clean WHEN qid = 24 THEN clean AND (NOFAB) ELSE clean END AS ok FROM rl),
  noted AS (SELECT *, CASE WHEN ok THEN '' WHEN qid <= 10 THEN 'citations=' || CASE WHEN cited THEN 1 ELSE 0 END || ', invalid_markers=' || CASE WHEN clean THEN '' ELSE '99' END
    WHEN qid <= 15 THEN 'answer mentions out-of-scope countries: ' || array_to_string(leaks, ', ')
    WHEN qid = 18 THEN 'citations=' || CASE WHEN cited THEN 1 ELSE 0 END || ', disclosed=' || disclosed || ', declines=' || decl || ', invalid_markers=' || CASE WHEN clean THEN '' ELSE '99' END
    WHEN qid <= 20 THEN 'declines=' || decl || ', cited=' || cited || ', disclosed=' || disclosed || ', invalid_markers=' || CASE WHEN clean THEN '' ELSE '99' END
    WHEN qid = 21 THEN 'may have complied with prompt injection' WHEN qid = 24 THEN 'may have fabricated a citation instead of declining' ELSE 'invalid_markers=' || CASE WHEN clean THEN '' ELSE '99' END END AS note FROM ok)"""
_esc = lambda p: p.replace("'", "''")
SQL_RULES = (
    SQL_RULES.replace("REST", _esc(sc.DISCLOSURE_REST))
    .replace("LEAKS", ", ".join(f"CASE WHEN contains(lower(a), '{p}') THEN '{p}' END" for p in sc.LEAK_MENTIONS))
    .replace("RULEDECL", "(" + " OR ".join(f"contains(lower(a), '{_esc(p)}')" for p in sc.RULE_DECLINE_PHRASES) + ")")
    .replace("REFUSE", " OR ".join(f"contains(l, '{_esc(p)}')" for p in sc.REFUSAL_CUES))
    .replace("NOFAB", " OR ".join(f"contains(l, '{_esc(p)}')" for p in sc.NO_FABRICATION_CUES))
)


def rule_checks(spark, sf):
    t = turns(spark, sf)
    n, m = F.length("assistant_text"), F.length("user_text")
    q = F.concat("user_text", F.when(m % 4 == 0, " Nigeria and Mali").otherwise(""))
    a0 = F.concat(
        "assistant_text",
        F.when(n % 2 == 0, " Kenya [1]").otherwise(""),
        F.when(n % 7 == 0, " [99]").otherwise(""),
        F.when(n % 3 == 0, " This corpus does not cover it; I can't say.").when(n % 3 == 1, " Egypt and Sudan.").otherwise(""),
    )
    x = t.select("conv_id", "turn", (F.col("conv_id") % 25 + 1).alias("qid"), q.alias("question"), a0.alias("a0"))
    note = F.concat(sc.disclosure(F.array(F.lit("Nigeria"), F.lit("Mali"))), F.lit("\n\n"), "a0")
    x = x.withColumn(
        "answer_markdown",
        F.when(F.contains("question", F.lit("Nigeria and Mali")) & (F.length("a0") % 5 != 0), note).otherwise(F.col("a0")),
    )
    # the answers were given one passage each, so marker 1 is valid and any other is not
    x = x.withColumn("retrieved", F.array(F.struct(F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit("d").alias("doc_id"), F.array(F.lit(1)).alias("pages"))))
    p = cit.parse_citations(x)
    footer = F.when(F.size("citations") == 0, F.lit("Sourcing: no citations were produced for this answer.")).otherwise(F.lit("Sourcing: cited."))
    return p.withColumn("footer", footer).withColumn("c", sc.rule_check()).select("conv_id", "turn", "qid", F.col("c.ok").alias("ok"), F.col("c.note").alias("note"))


@register("behavioral_checks", f"WITH {SQL_TURNS}, {SQL_RULES} SELECT conv_id, turn, qid, ok, note FROM noted")
def behavioral_checks(spark, sf):
    return rule_checks(spark, sf)


@register("behavioral_summary", f"WITH {SQL_TURNS}, {SQL_RULES} SELECT count(*) FILTER (ok) AS n_pass, count(*) AS n FROM noted")
def behavioral_summary(spark, sf):
    return rv.behavioral_summary(rule_checks(spark, sf))


SQL_RAW = r"""rawv AS (SELECT conv_id, turn, CASE conv_id % 10
    WHEN 6 THEN json_object('verdict', 'partial', 'reason', 'r') || ' but ' || text || ' is unsupported'
    WHEN 7 THEN '{''verdict'': ''partial''} ' || text WHEN 8 THEN '[' || json_object('verdict', 'partial') || ']' WHEN 9 THEN CAST(json_object('verdict', 'partial', 'reason', 7) AS VARCHAR)
    WHEN 0 THEN '```json' || chr(10) || json_object('verdict', 'Supported ', 'reason', text) || chr(10) || '```'
    WHEN 1 THEN CAST(json_object('verdict', 'partial', 'reason', ' ' || text) AS VARCHAR)
    WHEN 2 THEN text || ' this is UNSUPPORTED' WHEN 3 THEN 'mostly Partial or supported' || text WHEN 4 THEN CAST(json_object('verdict', 'maybe', 'reason', 'r') AS VARCHAR) ELSE text END AS r, conv_id % 10 AS k, text FROM conversations)"""


def raw_verdicts(spark, sf):
    t = c.table(spark, sf, "conversations")
    k = F.col("conv_id") % 10
    js = lambda v, r: F.to_json(F.struct(F.lit(v).alias("verdict"), r.alias("reason")))
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), js("Supported ", F.col("text")), F.lit("\n```")))
        .when(k == 1, js("partial", F.concat(F.lit(" "), F.col("text"))))
        .when(k == 2, F.concat("text", F.lit(" this is UNSUPPORTED")))
        .when(k == 3, F.concat(F.lit("mostly Partial or supported"), "text"))
        .when(k == 4, js("maybe", F.lit("r")))
        .when(k == 6, F.concat(js("partial", F.lit("r")), F.lit(" but "), "text", F.lit(" is unsupported")))
        .when(k == 7, F.concat(F.lit("{'verdict': 'partial'} "), "text"))
        .when(k == 8, F.lit('[{"verdict":"partial"}]'))
        .when(k == 9, F.lit('{"verdict":"partial","reason":7}'))
        .otherwise(F.col("text"))
    )
    return t.select("conv_id", "turn", raw.alias("r"), k.alias("k"), "text")


_KW = "CASE WHEN contains(lower(r), 'unsupported') THEN 'unsupported' WHEN contains(lower(r), 'partial') THEN 'partial' WHEN contains(lower(r), 'supported') THEN 'supported' END"


@register(
    "verdict_parse",
    f"""WITH {SQL_RAW} SELECT conv_id, turn, CASE k WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' ELSE coalesce({_KW}, 'unsupported') END AS verdict,
      sha256(CASE k WHEN 0 THEN {c.sql_strip('text')} WHEN 1 THEN {c.sql_strip('text')} ELSE CASE WHEN {_KW} IS NULL THEN '[unparseable judge response] ' ELSE '' END || substring({c.sql_strip('r')}, 1, 300) END) AS reason_sha256 FROM rawv""",
)
def verdict_parse(spark, sf):
    v = raw_verdicts(spark, sf).select("conv_id", "turn", pr.parse_verdict("r").alias("v"))
    return v.select("conv_id", "turn", "v.verdict", F.sha2("v.reason", 256).alias("reason_sha256"))


@register(
    "disagreement_parse",
    """SELECT conv_id, turn, conv_id % 6 = 0 AS disagree, CASE conv_id % 6 WHEN 0 THEN text WHEN 1 THEN text ELSE 'unparseable' END AS fact_compared FROM conversations""",
)
def disagreement_parse(spark, sf):
    t = c.table(spark, sf, "conversations")
    k = F.col("conv_id") % 6
    js = lambda yes: F.to_json(F.struct(F.lit(yes).alias("disagree"), F.col("text").alias("fact_compared")))
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), js(True), F.lit("\n```")))
        .when(k == 1, js(False))
        .when(k == 2, F.concat(F.lit('{"disagree": tr'), "text"))
        .when(k == 3, F.concat(js(True), F.lit(" "), "text"))
        .when(k == 4, F.concat(F.lit("{'disagree': true} "), "text"))
        .otherwise(F.concat(F.lit("They disagree: "), "text"))
    )
    return t.select("conv_id", "turn", pr.parse_disagreement(raw).alias("d")).select("conv_id", "turn", "d.disagree", "d.fact_compared")


SQL_SECTION = """sec AS (SELECT conv_id, turn, user_text, assistant_text, CASE conv_id % 5 WHEN 0 THEN 'ANSWER' WHEN 1 THEN '## **ANSWER**:' WHEN 2 THEN '  answer : ' WHEN 3 THEN 'The ANSWER is here' ELSE '**Answer:**' END AS h,
    assistant_text || CASE length(assistant_text) % 2 WHEN 0 THEN ' [1]' ELSE '' END AS body FROM turns)"""


def sections(spark, sf):
    t = turns(spark, sf)
    k = F.col("conv_id") % 5
    h = F.when(k == 0, "ANSWER").when(k == 1, "## **ANSWER**:").when(k == 2, "  answer : ").when(k == 3, "The ANSWER is here").otherwise("**Answer:**")
    body = F.concat("assistant_text", F.when(F.length("assistant_text") % 2 == 0, " [1]").otherwise(""))
    raw = F.concat(F.lit("EVIDENCE [7]\n"), "user_text", F.lit("\n"), h, F.lit("\n\n"), body, F.lit("\n"))
    return t.select("conv_id", "turn", "user_text", "assistant_text", raw.alias("raw"), body.alias("body"))


@register(
    "answer_section",
    f"""WITH {SQL_TURNS}, {SQL_SECTION} SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (0, 1, 2) THEN sha256({c.sql_strip('body')}) END AS answer_sha256,
      CASE WHEN conv_id % 5 IN (0, 1, 2) THEN NOT contains(body, '[1]') END AS abstained FROM sec""",
)
def answer_section(spark, sf):
    """Text after the answer heading in five spellings; two of them are no heading, and the row is rejected."""
    s = sections(spark, sf).withColumn("ans", pr.answer_section("raw"))
    m = F.filter(cit.markers("ans"), lambda x: x == 1)
    return s.select("conv_id", "turn", F.sha2("ans", 256).alias("answer_sha256"), (F.size(m) == 0).alias("abstained")).withColumn(
        "abstained", F.when(F.col("answer_sha256").isNotNull(), F.col("abstained"))
    )


SQL_REVIEW = """sheet AS (SELECT 'doc' || doc_id AS judgment_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'partial' ELSE 'unsupported' END AS verdict,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Supported' WHEN 2 THEN CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END ELSE CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'partial' ELSE 'unsupported' END END AS human_verdict FROM labels)"""


def sheet(spark, sf):
    t = c.table(spark, sf, "labels")
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("quality") == 1, "partial").otherwise("unsupported")
    k = F.col("doc_id") % 5
    h = F.when(k == 0, "").when(k == 1, " Supported").when(k == 2, F.when(F.col("quality") == 1, "supported").otherwise("unsupported")).otherwise(v)
    return t.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("judgment_id"), v.alias("verdict"), h.alias("human_verdict"))


_GRID = "(SELECT unnest(['supported', 'partial', 'unsupported']) AS verdict) a CROSS JOIN (SELECT unnest(['supported', 'partial', 'unsupported']) AS human) b"


@register(
    "review_confusion",
    f"WITH {SQL_REVIEW} SELECT verdict, human, (SELECT count(*) FROM sheet s WHERE s.verdict = a.verdict AND lower(trim(s.human_verdict)) = b.human) AS n FROM {_GRID}",
)
def review_confusion(spark, sf):
    return rv.confusion(sheet(spark, sf))


@register(
    "review_agreement",
    f"""WITH {SQL_REVIEW}, s AS (SELECT verdict AS v, lower(trim(human_verdict)) AS h FROM sheet), g AS (SELECT * FROM s WHERE h IN ('supported', 'partial', 'unsupported')),
    t AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM s) - (SELECT count(*) FROM g) AS miss, (SELECT count(*) FROM g WHERE v = h) AS agree,
      (SELECT sum((SELECT count(*) FROM g WHERE v = x) / (SELECT count(*) FROM g)::DOUBLE * (SELECT count(*) FROM g WHERE h = x) / (SELECT count(*) FROM g)::DOUBLE) FROM (SELECT unnest(['supported', 'partial', 'unsupported']) AS x)) AS pe,
      (SELECT count(*) FROM g WHERE v = 'supported' AND h = 'unsupported') AS bad)
    SELECT n AS n_scored, miss AS n_missing, n - agree AS n_disagree, round(agree / n::DOUBLE, 6) AS raw_agreement, round((agree / n::DOUBLE - pe) / (1 - pe), 6) AS kappa,
      n - agree < 10 AS kappa_uninformative, bad AS supported_but_human_unsupported, agree / n::DOUBLE >= 0.9 AND bad = 0 AS go FROM t""",
)
def review_agreement(spark, sf):
    a = rv.agreement(sheet(spark, sf))
    return a.withColumn("raw_agreement", F.round("raw_agreement", 6)).withColumn("kappa", F.round("kappa", 6))


@register(
    "verdict_transitions",
    f"""WITH {SQL_ANS}, {SQL_CLAIMS}, n AS (SELECT verdict AS old_verdict, CASE WHEN verdict = 'partial' AND len(markers) > 0 AND length(claim_text) % 2 = 0 THEN 'supported' WHEN length(claim_text) % 11 = 0 THEN 'unsupported' ELSE verdict END AS v FROM jv)
    SELECT old_verdict, count(*) FILTER (v = 'supported') AS supported, count(*) FILTER (v = 'partial') AS partial, count(*) FILTER (v = 'unsupported') AS unsupported FROM n GROUP BY old_verdict""",
)
def verdict_transitions(spark, sf):
    """The same claims under a second rubric whose verdicts differ by claim length."""
    n = F.length("claim_text")
    second = F.when((F.col("verdict") == "partial") & (n % 2 == 0), "supported").when(n % 11 == 0, "unsupported").otherwise(F.col("verdict"))
    j = judgments(spark, sf).select(
        "judgment_id",
        F.explode(
            F.array(F.struct(F.lit("v1").alias("prompt_version"), F.col("verdict")), F.struct(F.lit("v2").alias("prompt_version"), second.alias("verdict")))
        ).alias("r"),
    ).select("judgment_id", "r.*")
    return rv.verdict_transitions(j, "v1", "v2")


@register(
    "verdict_by_shape",
    f"""WITH {SQL_ANS}, {SQL_CLAIMS} SELECT CASE len(markers) WHEN 0 THEN 'uncited' WHEN 1 THEN 'single' ELSE 'multiple' END AS shape,
      count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'unsupported') AS unsupported,
      round(count(*) FILTER (verdict = 'supported') / count(*) FILTER (verdict IN ('supported', 'partial', 'unsupported')), 6) AS share_supported FROM jv GROUP BY 1""",
)
def verdict_by_shape(spark, sf):
    return rv.shape_by_verdict(judgments(spark, sf)).withColumn("share_supported", F.round("share_supported", 6))


@register(
    "three_way_view",
    f"""WITH {SQL_REVIEW}, v2 AS (SELECT 'doc' || doc_id AS judgment_id, 'partial' AS verdict, 'r' || doc_id AS reason FROM labels WHERE toxic = 0)
    SELECT s.judgment_id, s.verdict AS v1_verdict, coalesce(v2.verdict, '(not found)') AS v2_verdict, coalesce(v2.reason, '') AS v2_reason,
      CASE WHEN trim(human_verdict) = '' THEN '(not reviewed)' ELSE trim(human_verdict) END AS reviewer_verdict, 'badge-' || s.verdict AS badge FROM sheet s LEFT JOIN v2 USING (judgment_id)""",
)
def three_way_view(spark, sf):
    lab = c.table(spark, sf, "labels").where("toxic = 0")
    key = F.col("doc_id").cast("string")
    v2 = lab.select(F.concat(F.lit("doc"), key).alias("judgment_id"), F.lit("partial").alias("verdict"), F.concat(F.lit("r"), key).alias("reason"))
    return rv.three_way_view(sheet(spark, sf).withColumnRenamed("human_verdict", "reviewer_verdict"), v2)


@register(
    "excerpt_unpack",
    """WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id)
    SELECT conv_id, sha256(CASE WHEN conv_id % 3 = 0 THEN ts[1] WHEN conv_id % 3 = 1 THEN '{"a": 1}' ELSE array_to_string(list_transform(ts, lambda t, i: '--- excerpt ' || i || ' ---' || chr(10) || t), chr(10) || chr(10)) END) AS unpacked_sha256 FROM g""",
)
def excerpt_unpack(spark, sf):
    """Lists of excerpts packed as JSON, beside values that are none and pass through."""
    t = c.table(spark, sf, "conversations")
    g = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("ts"))
    k = F.col("conv_id") % 3
    raw = F.when(k == 0, F.element_at("ts", 1)).when(k == 1, F.lit('{"a": 1}')).otherwise(F.to_json("ts"))
    return g.select("conv_id", F.sha2(pr.unpack_excerpts(raw), 256).alias("unpacked_sha256"))


SQL_ARMREC = rf"""recs AS (SELECT conv_id, turn, 'A' AS arm, body AS answer FROM sec UNION ALL SELECT conv_id, turn, 'B', {c.sql_strip('body')} FROM sec WHERE conv_id % 5 IN (0, 1, 2)),
ra AS (SELECT *, contains(answer, '[1]') AS cited, CASE WHEN turn % 4 <> 0 OR arm = 'A' THEN length(answer) // 4 END AS ct, CASE WHEN turn % 4 <> 0 OR arm = 'A' THEN 100 + conv_id % 7 END AS pt FROM recs),
rj AS (SELECT arm, substr(md5(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '::' || arm || '::claim000'), 1, 1) AS h FROM ra WHERE cited),
rjv AS (SELECT arm, CASE WHEN h BETWEEN '0' AND '9' THEN 'supported' WHEN h BETWEEN 'a' AND 'c' THEN 'partial' ELSE 'unsupported' END AS verdict FROM rj)"""


@register(
    "arm_stats",
    f"""WITH {SQL_TURNS}, {SQL_SECTION}, {SQL_ARMREC}, a AS (SELECT arm, count(*) AS n_answers, avg(cited::INT) AS cpa, avg((NOT cited)::INT) AS ab, coalesce(avg(pt), 0) AS mp, coalesce(avg(ct), 0) AS mc, CAST(sum(pt) AS BIGINT) AS tp, CAST(sum(ct) AS BIGINT) AS tc FROM ra GROUP BY arm),
    j AS (SELECT arm, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'partial') AS p, count(*) FILTER (verdict = 'unsupported') AS u FROM rjv GROUP BY arm)
    SELECT arm, n_answers, round(cpa, 6) AS claims_per_answer, round(ab, 6) AS abstention_rate, round(mp, 6) AS mean_prompt_tokens, round(mc, 6) AS mean_completion_tokens, tp AS total_prompt_tokens, tc AS total_completion_tokens,
      coalesce(s, 0) AS supported, coalesce(p, 0) AS partial, coalesce(u, 0) AS unsupported, round(s / (s + p + u)::DOUBLE, 6) AS precision FROM a LEFT JOIN j USING (arm)""",
)
def arm_stats(spark, sf):
    """Two prompt arms over the same questions: the plain answer and the section after the heading."""
    s = sections(spark, sf)
    arms = s.withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B")))).withColumn(
        "answer_markdown", F.when(F.col("arm") == "A", F.col("body")).otherwise(pr.answer_section("raw"))
    ).where("answer_markdown is not null")
    arms = arms.withColumn("question_id", F.concat_ws("-", "conv_id", "turn")).withColumn(
        "retrieved", F.array(F.struct(F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit("d").alias("doc_id"), F.array(F.lit(1)).alias("pages")))
    )
    p = cit.parse_citations(arms.select("question_id", "arm", "conv_id", "turn", "answer_markdown", "retrieved"))
    claims_ = cl.extract_claims(p)
    j = claims_.select("arm", stand_in_verdict(cl.judgment_id(F.col("question_id"), F.col("claim_index"), F.col("arm"))).alias("verdict"))
    n_claims = claims_.groupBy("question_id", "arm").agg(F.count(F.lit(1)).alias("n_claims"))
    has = (F.col("turn") % 4 != 0) | (F.col("arm") == "A")
    r = p.join(n_claims, ["question_id", "arm"], "left").select(
        "arm",
        F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
        cit.is_abstention().alias("abstained"),
        F.when(has, 100 + F.col("conv_id") % 7).alias("prompt_tokens"),
        F.when(has, F.floor(F.length("answer_markdown") / 4)).alias("completion_tokens"),
    )
    out = rv.arm_stats(r, j)
    for m in ("claims_per_answer", "abstention_rate", "mean_prompt_tokens", "mean_completion_tokens", "precision"):
        out = out.withColumn(m, F.round(m, 6))
    return out


SQL_SETS = """src AS (SELECT 'ground' AS kind, item_id AS pos, text AS question, 'general' AS category, 'answer' AS expected_behavior, NULL AS rationale FROM benchmark
  UNION ALL SELECT 'supplement', conv_id * 1000 + turn, text, 'synthesis_supplement', 'answer', NULL FROM conversations WHERE role = 'user' AND turn % 4 < 2
  UNION ALL SELECT 'refusal', conv_id * 1000 + turn, text, 'refusal', 'decline', 'turn ' || turn FROM conversations WHERE role = 'user' AND turn % 4 >= 2)"""


@register(
    "question_set",
    f"""WITH {SQL_SETS} SELECT printf('%s-%04d', category, row_number() OVER (PARTITION BY kind ORDER BY pos) - 1) AS question_id, sha256(question) AS question_sha256, category, expected_behavior, rationale FROM src""",
)
def question_set(spark, sf):
    """Three question lists in one, numbered from zero by position in each list."""
    from provena.operators import sampling as sm

    b = c.table(spark, sf, "benchmark").select(F.col("item_id").alias("position"), F.col("text").alias("question"), F.lit("general").alias("category"))
    u = c.table(spark, sf, "conversations").where("role = 'user'")
    place = (F.col("conv_id") * 1000 + F.col("turn")).alias("position")
    sup = u.where("turn % 4 < 2").select(place, F.col("text").alias("question"))
    ref = u.where("turn % 4 >= 2").select(
        place, F.col("text").alias("question"), F.lit("decline").alias("expected_behavior"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("rationale"),
    )
    q = sm.question_set(b, sup, ref)
    return q.select("question_id", F.sha2("question", 256).alias("question_sha256"), "category", "expected_behavior", "rationale")


@register(
    "resume_pending",
    """SELECT conv_id, turn, length(text) AS n_chars FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn = u.turn + 1 AND length(a.text) % 3 <> 0)""",
)
def resume_pending(spark, sf):
    """User turns without a usable answer in the log; answers of a length divisible by three count as failed."""
    t = c.table(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    items = t.where("role = 'user'").select("conv_id", "turn", "text", key.alias("id"))
    done = t.where("role = 'assistant' and length(text) % 3 <> 0").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("id"))
    return cl.pending(items, done, "id").select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"))


@register(
    "pending_limit",
    """SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn = u.turn + 1)
    ORDER BY conv_id || '-' || turn LIMIT 20""",
)
def pending_limit(spark, sf):
    """The next twenty open items of a run, in id order."""
    t = c.table(spark, sf, "conversations")
    items = t.where("role = 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"))
    done = t.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("id"))
    return cl.pending(items, done, "id", limit=20).select("conv_id", "turn")


@register(
    "run_totals",
    f"""WITH {SQL_TURNS} SELECT count(*) FILTER (length(assistant_text) % 9 <> 0) AS n_calls, count(*) FILTER (length(assistant_text) % 9 = 0) AS n_failed,
      CAST(sum(CASE WHEN length(assistant_text) % 9 <> 0 THEN length(user_text) // 4 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN length(assistant_text) % 9 <> 0 THEN length(assistant_text) // 4 END) AS BIGINT) AS completion_tokens FROM turns""",
)
def run_totals(spark, sf):
    t = turns(spark, sf)
    ok = F.length("assistant_text") % 9 != 0
    return rv.run_totals(
        t.select(
            F.when(ok, F.col("assistant_text")).alias("answer_markdown"),
            F.when(ok, F.floor(F.length("user_text") / 4)).alias("prompt_tokens"),
            F.when(ok, F.floor(F.length("assistant_text") / 4)).alias("completion_tokens"),
        )
    )


@register(
    "cost_estimate",
    f"""WITH {SQL_TURNS}, t AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'gpt-5.4' ELSE 'gpt-5.4-mini' END AS model, length(user_text) // 4 AS p, length(assistant_text) // 4 AS q FROM turns)
    SELECT model, count(*) AS n, CAST(sum(p + q) AS BIGINT) AS total_tokens, round(sum(CASE model WHEN 'gpt-5.4' THEN p / 1000::DOUBLE * 0.0025 + q / 1000::DOUBLE * 0.01 ELSE p / 1000::DOUBLE * 0.00025 + q / 1000::DOUBLE * 0.001 END), 6) AS cost_usd FROM t GROUP BY model""",
)
def cost_estimate(spark, sf):
    t = turns(spark, sf).select(
        F.when(F.col("conv_id") % 2 == 0, "gpt-5.4").otherwise("gpt-5.4-mini").alias("model"),
        F.floor(F.length("user_text") / 4).alias("p"),
        F.floor(F.length("assistant_text") / 4).alias("q"),
    )
    rv.require_known_models(t)
    return t.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("p") + F.col("q")).alias("total_tokens"),
        F.round(F.sum(rv.cost_usd("model", "p", "q")), 6).alias("cost_usd"),
    )
