"""Registered queries: acquiring, validating, describing and chunking documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.operators import acquisition as aq
from provena.operators import chunking as ck
from provena.operators import coverage as cv
from provena.operators import dedup as dd
from provena.operators import html as ht
from provena.operators import metadata as md
from provena.operators import pages as pg
from provena.operators import quality as ql
from provena.operators import reconcile as rc
from provena.plans import common as c
from provena.session import cut_lineage
from provena.sources import declarations as dc
from provena.sources import stores as st

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Topics and tracked organizations of the driver corpus.
TOPICS = ("ation", "ment", "heit", "ción", "ing")
UNSTABLE = ("src1", "src2")


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def declared(spark, sf, keep_text: bool = False, included=None):
    """Declarations, observed files and baselines, all read off the documents table; of the documents in ``included`` alone, if given.

    The first line is the title, the last the rationale. Half of the documents declared as PDF or JSON are such; a
    fifth of the pages and records are asked for under a title that they do not hold.
    """
    d = c.documents(spark, sf) if included is None else md.included_only(c.documents(spark, sf), included)
    sha = F.sha2("text", 256)
    n = F.col("n_chars")
    even = F.col("doc_id") % 2 == 0
    title = F.substring_index("text", "\n", 1)
    fmt = F.when(n % 3 == 0, "pdf").when(n % 3 == 1, "html").otherwise("json")
    as_json = F.to_json(F.struct(F.struct(F.concat(F.lit("a "), "text").alias("text")).alias("incident")))
    body = F.when((fmt == "pdf") & even, F.concat(F.lit("%PDF-1.7 "), "text")).when((fmt == "json") & even, as_json).otherwise(F.col("text"))
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Zzyzx "), title)).otherwise(title)
    out = d.select(
        F.col("doc_id"),
        F.col("source").alias("org"),
        title.alias("title"),
        F.col("source").alias("organization"),
        F.array("lang", "source").alias("countries"),
        F.format_string("%d-%02d-15", 2020 + n % 8, 1 + F.col("doc_id") % 12).alias("publication_date"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("report").alias("doc_type"),
        fmt.alias("source_format"),
        tx.found_phrases("text", TOPICS).alias("topics"),
        F.col("lang").alias("language"),
        F.substring_index("text", "\n", -1).alias("selection_rationale"),
        F.when(n % 10 == 0, "v0.9").otherwise("v1.0").alias("corpus_version"),
        F.when(F.col("lang") == "de", "manual").alias("acquisition"),
        F.when(n % 7 == 0, "REPLACE_ME").when(n % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(sha).alias("sha256"),
        F.when(n % 11 != 0, sha).alias("file_sha256"),
        F.when(F.col("source").isin(*UNSTABLE) & (n % 2 == 0), sha).alias("derived_sha256"),
        ql.format_problem(body, fmt, asked).alias("format_problem"),
        F.octet_length("text").alias("file_size_bytes"),
        *(["text"] if keep_text else []),
    )
    return out


def org_table(spark, sf):
    return (
        c.table(spark, sf, "documents").select(F.col("source").alias("org")).distinct().select(
            "org",
            F.when(F.col("org") == "src5", "manual").otherwise("auto").alias("default_acquisition"),
            (~F.col("org").isin(*UNSTABLE)).alias("raw_bytes_stable"),
        )
    )


def states(spark, sf):
    return aq.acquisition_states(dc.resolve_modes(declared(spark, sf), org_table(spark, sf)))


_TOPIC_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TOPICS) + "], lambda x: x IS NOT NULL)"

SQL_DECL = rf"""decl AS (
  SELECT doc_id, source AS org, split_part(text, chr(10), 1) AS title, source AS organization, lang, text, n_chars,
    printf('%d-%02d-15', 2020 + n_chars % 8, 1 + doc_id % 12) AS publication_date,
    'https://' || source || '.example/' || doc_id AS url,
    CASE n_chars % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'json' END AS source_format,
    {_TOPIC_SQL} AS topics,
    CASE WHEN n_chars % 10 = 0 THEN 'v0.9' ELSE 'v1.0' END AS corpus_version,
    CASE WHEN lang = 'de' OR source = 'src5' THEN 'manual' ELSE 'auto' END AS acquisition,
    source NOT IN ('src1', 'src2') AS stable,
    CASE WHEN n_chars % 7 = 0 THEN 'REPLACE_ME' WHEN n_chars % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256,
    CASE WHEN n_chars % 11 <> 0 THEN sha256(text) END AS file_sha256,
    CASE WHEN source IN ('src1', 'src2') AND n_chars % 2 = 0 THEN sha256(text) END AS derived_sha256,
    CASE WHEN n_chars % 3 = 0 THEN CASE WHEN doc_id % 2 <> 0 AND substring(text, 1, 5) <> '%PDF-'
        THEN 'bad PDF magic number (got ''' || substring(text, 1, 5) || ''', expected ''%PDF-'')' END
      WHEN n_chars % 3 = 2 AND doc_id % 2 <> 0 THEN CASE WHEN NOT json_valid(text) THEN 'not valid JSON' END
      WHEN doc_id % 5 = 0 THEN 'declared title ''Zzyzx ' || split_part(text, chr(10), 1) || ''' not found in '
        || CASE WHEN n_chars % 3 = 2 THEN '''incident.text'' (missing key word(s): zzyzx): likely the wrong record'
           ELSE 'fetched content (missing key word(s): zzyzx): likely a challenge page' END
      END AS format_problem
  FROM documents)"""

SQL_STATES = """base AS (SELECT *, CASE WHEN stable THEN sha256 ELSE coalesce(derived_sha256,
    CASE WHEN sha256 <> '' AND NOT starts_with(sha256, 'REPLACE_ME') THEN sha256 END) END AS b FROM decl),
states AS (SELECT *,
  CASE WHEN stable AND starts_with(sha256, 'REPLACE_ME') THEN 'failed'
    WHEN b IS NULL AND file_sha256 IS NOT NULL AND format_problem IS NOT NULL THEN 'failed'
    WHEN b IS NULL AND file_sha256 IS NOT NULL THEN 'bootstrapped'
    WHEN b IS NULL AND acquisition = 'manual' THEN 'pending'
    WHEN b IS NULL THEN 'fetch'
    WHEN file_sha256 = b AND format_problem IS NOT NULL THEN 'failed'
    WHEN file_sha256 = b THEN 'present'
    WHEN file_sha256 IS NOT NULL AND acquisition = 'manual' THEN 'failed'
    WHEN file_sha256 IS NOT NULL THEN 'refetch'
    WHEN acquisition = 'manual' THEN 'pending' ELSE 'fetch' END AS state,
  CASE WHEN stable AND starts_with(sha256, 'REPLACE_ME') THEN 'placeholder sha256'
    WHEN b IS NULL AND file_sha256 IS NOT NULL AND format_problem IS NOT NULL THEN 'cannot bootstrap from existing file: ' || format_problem
    WHEN b IS NULL AND file_sha256 IS NOT NULL THEN 'baseline recorded from existing file'
    WHEN b IS NULL AND acquisition = 'manual' THEN 'manual acquisition, not yet placed'
    WHEN b IS NULL THEN 'first fetch, baseline to be recorded'
    WHEN file_sha256 = b AND format_problem IS NOT NULL THEN 'checksum matches, but: ' || format_problem
    WHEN file_sha256 = b THEN 'checksum matches'
    WHEN file_sha256 IS NOT NULL AND acquisition = 'manual' THEN 'checksum mismatch (manual acquisition)'
    WHEN file_sha256 IS NOT NULL THEN 'present but checksum mismatch'
    WHEN acquisition = 'manual' THEN 'manual acquisition, not yet placed' ELSE 'absent' END AS reason FROM base)"""


@register("acquisition_state", f"WITH {SQL_DECL}, {SQL_STATES} SELECT doc_id, state, reason, CASE WHEN state IN ('bootstrapped', 'present') THEN file_sha256 END AS sha256_recorded FROM states")
def acquisition_state(spark, sf):
    return states(spark, sf).select("doc_id", "state", "reason", "sha256_recorded")


@register("acquisition_state_counts", f"WITH {SQL_DECL}, {SQL_STATES} SELECT state, count(*) AS n_docs FROM states GROUP BY state")
def acquisition_state_counts(spark, sf):
    return aq.state_counts(states(spark, sf))


@register(
    "manifest_rows",
    f"""WITH {SQL_DECL}, {SQL_STATES} SELECT doc_id, org, title, lang || ',' || org AS countries, publication_date,
    file_sha256 AS sha256, 'data/raw/' || org || '/' || doc_id AS local_path,
    file_sha256 || '  data/raw/' || org || '/' || doc_id AS checksum_line FROM states WHERE state IN ('present', 'bootstrapped')""",
)
def manifest_rows(spark, sf):
    rows = aq.manifest_rows(states(spark, sf)).withColumn("sha256", F.col("sha256_recorded")).withColumn(
        "local_path", F.concat(F.lit("data/raw/"), "org", F.lit("/"), F.col("doc_id").cast("string"))
    )
    return dc.manifest_lines(rows).withColumn("checksum_line", F.concat_ws("  ", "sha256", "local_path"))


@register(
    "declared_format_check",
    r"""WITH p AS (
      SELECT page_id, html, CASE WHEN starts_with(url, 'https://m.') THEN 'json' WHEN starts_with(url, 'http://') THEN 'pdf' ELSE 'html' END AS fmt,
        regexp_extract(url, '^https?://([^/]+)/', 1) || ' ' || regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
    m AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS tm,
        trim(regexp_replace(regexp_replace(lower(html), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS bm FROM p),
    x AS (SELECT *, list_filter(string_split(tm, ' '), lambda w: length(w) > 2
        AND NOT list_contains(['the','on','of','and','a','an','in','to','for','is','at'], w) AND NOT contains(bm, w)) AS missing,
        CASE WHEN contains(lower(html), 'verifying your browser') THEN 'verifying your browser'
             WHEN contains(lower(html), 'enable javascript to continue') THEN 'enable javascript to continue'
             WHEN contains(lower(html), 'checking your browser') THEN 'checking your browser'
             WHEN contains(lower(html), 'security checkpoint') THEN 'security checkpoint'
             WHEN contains(lower(html), 'just a moment') THEN 'just a moment' END AS ch FROM m)
    SELECT page_id, fmt AS source_format, CASE
      WHEN fmt = 'pdf' THEN CASE WHEN substring(html, 1, 5) <> '%PDF-' THEN 'bad PDF magic number (got ''' || substring(html, 1, 5) || ''', expected ''%PDF-'')' END
      WHEN fmt = 'json' THEN CASE WHEN NOT json_valid(html) THEN 'not valid JSON' ELSE 'other' END
      WHEN ch IS NOT NULL THEN 'matched known bot-challenge phrase: ''' || ch || ''''
      WHEN len(missing) > 0 THEN 'declared title ''' || title || ''' not found in fetched content (missing key word(s): ' || array_to_string(missing, ', ') || '): likely a challenge page'
      END AS problem FROM x""",
)
def declared_format_check(spark, sf):
    """Raw pages against a declared format by address and a title that also names the host."""
    p = c.spread(c.table(spark, sf, "pages"))
    fmt = (
        F.when(F.startswith("url", F.lit("https://m.")), "json").when(F.startswith("url", F.lit("http://")), "pdf").otherwise("html")
    )
    title = F.concat(
        F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.lit(" "), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    )
    p = p.select("page_id", "html", fmt.alias("source_format"), title.alias("title"))
    return p.select("page_id", "source_format", ql.format_problem("html", "source_format", "title").alias("problem"))


_HTML_SQL = f"regexp_replace(html, '{ht.COMMENT}', '', 'g')"
for _e in ht.DROPPED:
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{ht.dropped_element(_e)}', '', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '{ht.TAG}', chr(10), 'g')"
for _a, _b in ht.ENTITIES:
    _HTML_SQL = "replace({}, '{}', '{}')".format(_HTML_SQL, _a, _b.replace("'", "''"))
_HTML_SQL = rf"regexp_replace({_HTML_SQL}, '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g')"
_HTML_SQL = rf"regexp_replace({_HTML_SQL}, '^[ \t\r\n]+|[ \t\r\n]+\z', '', 'g')"


@register("html_main_text", f"SELECT page_id, t AS main_text, CASE WHEN t = '' THEN 'empty' ELSE 'ok' END AS outcome FROM (SELECT page_id, {_HTML_SQL} AS t FROM pages)")
def html_main_text(spark, sf):
    p = c.spread(c.table(spark, sf, "pages")).select("page_id", ht.main_text("html").alias("main_text"))
    return p.withColumn("outcome", st.extraction_outcome(F.col("main_text"), F.lit(True)))


@register(
    "json_field_extract",
    f"""WITH j AS (SELECT event_id, json_object('incident', json_object('text', CASE WHEN event_type = 'error' THEN '' ELSE '  ' || event_type || ' ' || json_extract_string(props, '$.k') || chr(10) END)) AS body FROM events)
    SELECT event_id, {c.sql_strip("coalesce(json_extract_string(body, '$.incident.text'), '')")} AS text,
      CASE WHEN {c.sql_strip("coalesce(json_extract_string(body, '$.incident.text'), '')")} = '' THEN 'empty' ELSE 'ok' END AS outcome FROM j""",
)
def json_field_extract(spark, sf):
    """The report field of JSON bodies built from events."""
    e = c.table(spark, sf, "events")
    words = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.concat(F.lit("  "), "event_type", F.lit(" "), F.get_json_object("props", "$.k"), F.lit("\n"))
    )
    body = F.to_json(F.struct(F.struct(words.alias("text")).alias("incident")))
    out = e.select("event_id", ql.json_incident_text(body).alias("text"))
    return out.withColumn("outcome", st.extraction_outcome(F.col("text"), F.lit(True)))


@register(
    "content_hash_duplicates",
    r"""SELECT sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_sha256,
    count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def content_hash_duplicates(spark, sf):
    d = c.documents(spark, sf).select("doc_id", tx.content_sha256("text").alias("content_sha256"))
    return (
        d.groupBy("content_sha256")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("n_docs > 1")
    )


@register(
    "content_drift_report",
    """WITH b AS (SELECT doc_id, source IN ('src1', 'src2', 'src3') AS tracked, sha256(text) AS actual,
      CASE n_chars % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text || 'x') END AS baseline FROM documents)
    SELECT doc_id, CASE WHEN NOT tracked THEN 'untracked' WHEN baseline IS NULL THEN 'bootstrap' WHEN actual = baseline THEN 'verified' ELSE 'drifted' END AS drift_status,
      CASE WHEN NOT tracked THEN 'untracked' WHEN baseline IS NULL THEN 'no_baseline' WHEN actual = baseline THEN 'verified' ELSE 'mismatch' END AS rehydration_status,
      CASE WHEN tracked AND baseline IS NOT NULL THEN actual <> baseline END AS drifted,
      CASE WHEN tracked AND baseline IS NULL THEN actual ELSE baseline END AS content_sha256_after FROM b""",
)
def content_drift_report(spark, sf):
    """Drift against recorded content hashes, and the baseline table after new ones are recorded."""
    d = c.documents(spark, sf)
    base = F.when(F.col("n_chars") % 3 == 0, F.sha2("text", 256)).when(
        F.col("n_chars") % 3 == 1, F.sha2(F.concat("text", F.lit("x")), 256)
    )
    tracked = F.col("source").isin("src1", "src2", "src3")
    d = d.withColumn("_base", base)
    report = d.select(
        "doc_id",
        F.col("source").alias("org"),
        ql.drift_status(F.col("text"), F.col("_base"), tracked).alias("drift_status"),
        ql.rehydration_status(F.col("text"), F.col("_base"), tracked).alias("rehydration_status"),
        ql.drift(F.col("text"), F.col("_base"), tracked)["drifted"].alias("drifted"),
        tx.content_sha256("text").alias("_actual"),
        "_base",
    )
    keyed = report.select("org", "doc_id", F.lit("content_sha256").alias("field"), F.col("_base").alias("value"))
    new = report.where("drift_status = 'bootstrap'").select("org", "doc_id", F.lit("content_sha256").alias("field"), F.col("_actual").alias("value"))
    after = dc.upsert_checksums(keyed.where("value is not null"), new).select("doc_id", F.col("value").alias("content_sha256_after"))
    return report.drop("org", "_actual", "_base").join(after, "doc_id", "left")


@register(
    "migrated_baselines",
    f"""WITH {SQL_DECL} SELECT doc_id, org, 'sha256' AS field, sha256 AS value FROM decl
    WHERE NOT stable AND derived_sha256 IS NULL AND NOT starts_with(sha256, 'REPLACE_ME')""",
)
def migrated_baselines(spark, sf):
    d = declared(spark, sf).where(F.col("org").isin(*UNSTABLE))
    derived = d.where("derived_sha256 is not null").select(
        "org", "doc_id", F.lit("sha256").alias("field"), F.col("derived_sha256").alias("value")
    )
    return aq.migrated_baselines(d, derived).select("doc_id", "org", "field", "value")


_WORDS_SQL = f"CASE WHEN {c.sql_strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({c.sql_strip('text')}, '{tx.WS}+')) END"
_LANG_SQL = """(SELECT arg_min(l, ord) FROM (SELECT unnest(ls) AS l, unnest(hs) AS h, unnest([1,2,3,4]) AS ord) WHERE h = list_max(hs))"""


def _profile_sql() -> str:
    parts = []
    for _, ws in sorted(ql.LANGUAGE_PROFILE.items()):
        parts.append(f"len(list_filter(tokens, lambda t: list_contains({c.sql_list(ws)}, t)))")
    hits = "[" + ", ".join(parts) + "]"
    return rf"""lang AS (SELECT doc_id, CASE WHEN list_max(hs) = 0 THEN 'unknown' ELSE ['de','en','es','fr'][list_position(hs, list_max(hs))] END AS language,
      CASE WHEN n > 0 THEN round_even(list_max(hs) / n::DOUBLE, 4)::DOUBLE ELSE 0.0 END AS language_confidence FROM (
      SELECT doc_id, len(tokens) AS n, {hits} AS hs FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS tokens FROM documents)))"""


@register("language_by_stopwords", f"WITH {_profile_sql()} SELECT doc_id, language, CAST(language_confidence AS DOUBLE) AS language_confidence FROM lang")
def language_by_stopwords(spark, sf):
    d = c.documents(spark, sf).select("doc_id", ql.detect_language("text").alias("l"))
    return d.select("doc_id", F.col("l.language").alias("language"), F.col("l.confidence").alias("language_confidence"))


SQL_SIMHASH = r"""sh AS (SELECT doc_id, CASE WHEN length(s) < 4 THEN [s] ELSE list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4)) END AS g
    FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') AS s FROM documents WHERE keep_doc(doc_id))),
  hx AS (SELECT doc_id, ('0x' || substr(md5(p), 17, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(g) AS p FROM sh)),
  sigs AS (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::UBIGINT AS sig FROM (
    SELECT doc_id, b, sum((h >> b) & 1) AS ones, count(*) AS n FROM hx, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY doc_id, b) GROUP BY doc_id),
  grp AS (SELECT sig, count(*) AS n_docs, min(doc_id) AS first_doc FROM sigs GROUP BY sig),
  edges AS (SELECT a.sig AS sig_a, b.sig AS sig_b, bit_count(xor(a.sig, b.sig)) AS distance, a.n_docs AS docs_a, b.n_docs AS docs_b, a.first_doc AS first_a, b.first_doc AS first_b
    FROM grp a, grp b WHERE a.sig <> b.sig AND bit_count(xor(a.sig, b.sig)) <= 3),
  near AS (SELECT sigs.doc_id, sigs.sig, grp.n_docs - 1 AS n_copies, grp.n_docs - 1 + coalesce(e.nn, 0) AS n_near, least(grp.first_doc, coalesce(e.f, grp.first_doc)) AS group_min
    FROM sigs JOIN grp ON grp.sig = sigs.sig LEFT JOIN (SELECT sig_a, sum(docs_b) AS nn, min(first_b) AS f FROM edges GROUP BY sig_a) e ON e.sig_a = sigs.sig)"""
_ALL_DOCS = SQL_SIMHASH.replace("WHERE keep_doc(doc_id)", "")


@register("near_duplicates", f"WITH {_ALL_DOCS} SELECT doc_id, lpad(lower(to_hex(sig)), 16, '0') AS signature, CAST(n_copies AS BIGINT) AS n_copies, CAST(n_near AS BIGINT) AS n_near, group_min FROM near")
def near_duplicates(spark, sf):
    near = dd.near_duplicates(dd.signatures(c.documents(spark, sf)))
    return near.select("doc_id", dd.signature_hex("signature").alias("signature"), "n_copies", "n_near", "group_min")


@register(
    "near_duplicate_edges",
    f"""WITH {_ALL_DOCS} SELECT lpad(lower(to_hex(least(sig_a, sig_b))), 16, '0') AS sig_low, lpad(lower(to_hex(greatest(sig_a, sig_b))), 16, '0') AS sig_high,
    CAST(distance AS INTEGER) AS distance FROM edges WHERE sig_a < sig_b""",
)
def near_duplicate_edges(spark, sf):
    """Pairs of distinct signatures within three bits; with the signature of each document this is every pair."""
    sigs = cut_lineage(dd.signatures(c.documents(spark, sf)))  # used twice below
    pairs = dd.near_signature_pairs(dd.signature_groups(sigs))
    a, b = dd.signature_hex("sig_a"), dd.signature_hex("sig_b")
    return pairs.select(F.least(a, b).alias("sig_low"), F.greatest(a, b).alias("sig_high"), "distance")


def validation(spark, sf, included=None):
    """Validation results of all documents or of those in ``included``; near-duplicates are looked for among all either way."""
    d = c.documents(spark, sf)
    n = F.col("n_chars")
    sha = F.sha2("text", 256)
    facts = [
        "doc_id",
        F.col("source").alias("org"),
        "text",
        sha.alias("actual_sha256"),
        F.when(n % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(sha).alias("recorded_sha256"),
        F.when(n % 3 == 0, sha).when(n % 3 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).alias("content_baseline"),
    ]
    docs = d.select(*facts)
    ok = ql.tier1(F.col("text"), F.col("actual_sha256"), F.col("recorded_sha256"))
    survivors = docs.where(ok["extraction_ok"] & ok["integrity_ok"])
    near = dd.near_duplicates(dd.signatures(survivors))
    docs = docs if included is None else md.included_only(d, included).select(*facts)
    return ql.validate(docs, near.select("doc_id", "n_near", "group_min"), F.col("org").isin("src1", "src2", "src3"))


SQL_VALID = SQL_SIMHASH.replace("keep_doc(doc_id)", "n_chars % 13 <> 0 AND length(text) > 0") + f""",
  {_profile_sql()},
  valid AS (SELECT d.doc_id, d.source AS org, length(text) > 0 AS extraction_ok, n_chars % 13 <> 0 AS integrity_ok,
      length(text) > 0 AND n_chars % 13 <> 0 AS tier1_passed, {_WORDS_SQL} AS word_count, lang.language, lang.language_confidence,
      coalesce(near.n_near, 0) AS n_near, near.group_min,
      source IN ('src1', 'src2', 'src3') AND n_chars % 3 = 1 AS drifted
    FROM documents d JOIN lang USING (doc_id) LEFT JOIN near USING (doc_id)),
  flagged AS (SELECT *, CASE WHEN tier1_passed THEN list_filter([
      CASE WHEN language <> 'en' THEN 'language detected as ''' || language || ''', not English' END,
      CASE WHEN word_count < 500 THEN 'only ' || word_count || ' words (below the 500 minimum)' END,
      CASE WHEN n_near > 0 THEN 'near-duplicate of ' || n_near || ' document(s), group of ' || group_min END,
      CASE WHEN drifted THEN 'content hash drifted from recorded baseline' END], lambda x: x IS NOT NULL) END AS flags FROM valid)"""


@register(
    "validation_flags",
    f"""WITH {SQL_VALID} SELECT doc_id, org, tier1_passed, CASE WHEN tier1_passed THEN NULL ELSE array_to_string(list_filter([
        CASE WHEN NOT extraction_ok THEN 'extraction failed or produced an empty file' END,
        CASE WHEN NOT integrity_ok THEN 'SHA-256 no longer matches the raw file' END], lambda x: x IS NOT NULL), '; ') END AS tier1_reason,
      CASE WHEN tier1_passed THEN CAST(word_count AS INTEGER) END AS word_count, CASE WHEN tier1_passed THEN language END AS language,
      CASE WHEN tier1_passed THEN n_near END::BIGINT AS near_duplicates,
      CASE WHEN tier1_passed THEN CASE WHEN len(flags) > 0 THEN 'flagged' ELSE 'clean' END ELSE 'excluded' END AS status,
      CASE WHEN tier1_passed THEN array_to_string(flags, '; ') END AS flags FROM flagged""",
)
def validation_flags(spark, sf):
    v = validation(spark, sf)
    return v.select(
        "doc_id",
        "org",
        "tier1_passed",
        "tier1_reason",
        F.col("tier2.word_count").alias("word_count"),
        F.col("tier2.language").alias("language"),
        F.col("tier2.near_duplicates").alias("near_duplicates"),
        F.when(~F.col("tier1_passed"), "excluded").when(F.size("tier2_flags") > 0, "flagged").otherwise("clean").alias("status"),
        F.array_join("tier2_flags", "; ").alias("flags"),
    )


@register("topic_hints", f"SELECT doc_id, array_to_string(t, ', ') AS topics, CAST(len(t) AS INTEGER) AS n_topics FROM (SELECT doc_id, {_TOPIC_SQL} AS t FROM documents)")
def topic_hints(spark, sf):
    d = c.documents(spark, sf).select("doc_id", ql.topic_hints("text", TOPICS).alias("t"))
    return d.select("doc_id", F.array_join("t", ", ").alias("topics"), F.size("t").alias("n_topics"))


@register(
    "decision_log",
    f"""WITH {SQL_VALID}, {SQL_DECL}, {SQL_STATES}
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'exclusion' AS kind, 'SHA-256 no longer matches the raw file' AS reason FROM valid WHERE NOT integrity_ok AND extraction_ok
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'acquisition-failure', reason FROM states WHERE state = 'failed'
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'content-drift', 'content hash drifted from recorded baseline' FROM valid WHERE tier1_passed AND drifted""",
)
def decision_log(spark, sf):
    """The three kinds of automatic log entries in one append-only table."""
    v = validation(spark, sf)
    at = "2026-01-01"
    out = (
        st.decision_events(v.where(~F.col("tier1_passed")), "exclusion", F.col("tier1_reason"), at)
        .unionByName(st.decision_events(states(spark, sf).where("state = 'failed'"), "acquisition-failure", F.col("reason"), at))
        .unionByName(
            st.decision_events(v.where("tier2.content_drift.drifted"), "content-drift", F.lit("content hash drifted from recorded baseline"), at)
        )
    )
    return out.drop("at")


def lines_as_pages(spark, sf):
    d = c.documents(spark, sf)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("page"), "text"
    )


SQL_PAGES = """pg AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS page, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  bp AS (SELECT doc_id, page, s AS char_start, s + n AS char_end FROM (SELECT doc_id, page, length(t) AS n,
    coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pg WHERE length(t) > 0))"""


@register("page_breakpoints", f"WITH {SQL_PAGES} SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM bp")
def page_breakpoints(spark, sf):
    return pg.page_breakpoints(lines_as_pages(spark, sf))


@register(
    "chunk_page_ranges",
    f"""WITH {SQL_PAGES}, total AS (SELECT doc_id, max(char_end) AS n FROM bp GROUP BY doc_id),
    ch AS (SELECT doc_id, i, i * 750 AS s, least(i * 750 + 1500, n) AS e FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 1500) / 750.0)) AS INTEGER) + 1)) AS i FROM total))
    SELECT printf('%s-chunk-%04d', CAST(ch.doc_id AS VARCHAR), i) AS chunk_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, CAST(count(page) AS INTEGER) AS n_pages
    FROM ch LEFT JOIN bp ON bp.doc_id = ch.doc_id AND bp.char_start < ch.e AND bp.char_end > ch.s GROUP BY ch.doc_id, i""",
)
def chunk_page_ranges(spark, sf):
    """Pages of every window over the assembled text, lines standing for pages."""
    marks = pg.page_breakpoints(lines_as_pages(spark, sf))
    total = marks.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    win = total.select("doc_id", F.explode(ck.windows("n")).alias("w")).select(
        "doc_id",
        F.format_string("%s-chunk-%04d", F.col("doc_id").cast("string"), F.col("w.chunk_index")).alias("chunk_id"),
        F.col("w.char_start").alias("char_start"),
        F.col("w.char_end").alias("char_end"),
    )
    out = pg.chunk_pages(win, marks)
    return out.select(
        "chunk_id", F.array_join("pages", ",").alias("pages"), F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages")
    )


@register(
    "document_metadata",
    f"""WITH {SQL_VALID}, {SQL_DECL}
    SELECT d.doc_id, '1.1' AS schema_version, d.title, d.organization, d.publication_date, d.url, {c.sql_strip("regexp_replace(string_split(d.text, chr(10))[-1], '" + tx.WS + "+', ' ', 'g')")} AS selection_rationale,
      CAST(strlen(d.text) AS BIGINT) AS file_size_bytes, CAST(f.word_count AS INTEGER) AS extracted_word_count,
      CASE d.source_format WHEN 'pdf' THEN 'pdf-text' WHEN 'json' THEN 'json-field-extraction' ELSE 'html-main-text' END AS extraction_method,
      f.language AS detected_language, CAST(f.language_confidence AS DOUBLE) AS detected_language_confidence,
      CASE WHEN len(f.flags) > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS validation_status, CAST(len(f.flags) AS INTEGER) AS n_warnings, 'active' AS lifecycle_status
    FROM decl d JOIN flagged f ON f.doc_id = d.doc_id AND f.tier1_passed JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1""",
)
def document_metadata(spark, sf):
    """Records of the documents labelled good: declared, derived and lifecycle blocks."""
    included = c.table(spark, sf, "labels").where("quality = 1")
    decl = declared(spark, sf, included=included).withColumn("extraction_date", F.lit("2026-01-01"))
    r = md.metadata_records(included, decl, validation(spark, sf, included))
    return r.select(
        "doc_id", "schema_version", "declared.title", "declared.organization", "declared.publication_date", "declared.url",
        "declared.selection_rationale", "derived.file_size_bytes", "derived.extracted_word_count", "derived.extraction_method",
        "derived.detected_language", "derived.detected_language_confidence", "derived.validation_status",
        F.size("derived.validation_warnings").alias("n_warnings"), F.col("lifecycle.status").alias("lifecycle_status"),
    )


@register(
    "metadata_gaps",
    """SELECT l.doc_id, CASE WHEN d.n_chars % 7 = 0 THEN 'not declared' WHEN NOT (length(text) > 0 AND n_chars % 13 <> 0) THEN 'tier 1 failed' END AS problem
    FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 AND (n_chars % 7 = 0 OR NOT (length(text) > 0 AND n_chars % 13 <> 0))""",
)
def metadata_gaps(spark, sf):
    """Included documents that cannot get a record, where placeholders count as undeclared."""
    d = c.documents(spark, sf)
    included = c.table(spark, sf, "labels").where("quality = 1")
    decl = d.where("n_chars % 7 <> 0").select("doc_id")
    val = d.select("doc_id", ((F.length("text") > 0) & (F.col("n_chars") % 13 != 0)).alias("tier1_passed"))
    return md.missing_inputs(included, decl, val)


SQL_LINKS = "links AS (SELECT doc_id, doc_id + 1 AS superseded_by FROM labels WHERE quality = 0)"


@register(
    "lifecycle_filter",
    f"""WITH RECURSIVE {SQL_LINKS}, walk AS (SELECT doc_id, superseded_by AS cur, 1 AS depth FROM links
      UNION ALL SELECT w.doc_id, l.superseded_by, w.depth + 1 FROM walk w JOIN links l ON l.doc_id = w.cur),
    ends AS (SELECT doc_id, arg_max(cur, depth) AS current_doc, max(depth) AS depth FROM walk GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN 'active' ELSE 'superseded' END AS lifecycle_status, coalesce(e.current_doc, d.doc_id) AS current_doc, CAST(coalesce(e.depth, 0) AS BIGINT) AS depth
    FROM documents d LEFT JOIN ends e USING (doc_id)""",
)
def lifecycle_filter(spark, sf):
    """Documents labelled bad are superseded by the next id; every document's current version and chain length."""
    links = c.table(spark, sf, "labels").where("quality = 0").select("doc_id", (F.col("doc_id") + 1).alias("superseded_by"))
    ends = md.resolve_supersession(links)
    d = c.table(spark, sf, "documents").select("doc_id")
    return d.join(ends, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("current_doc").isNull(), "active").otherwise("superseded").alias("lifecycle_status"),
        F.coalesce("current_doc", "doc_id").alias("current_doc"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


@register(
    "version_drift",
    f"""WITH {SQL_DECL} SELECT doc_id, corpus_version AS declared_version, CASE WHEN n_chars % 4 <> 0 THEN 'v1.0' END AS chunked_version,
    coalesce(CASE WHEN n_chars % 4 <> 0 THEN 'v1.0' END = split_part('v1.0 2026-07-13', ' ', 1), false) AS in_index FROM decl
    WHERE CASE WHEN n_chars % 4 <> 0 THEN 'v1.0' END IS DISTINCT FROM corpus_version""",
)
def version_drift(spark, sf):
    """Documents whose chunks carry another version than they declare, and whether the index would take them."""
    d = c.table(spark, sf, "documents")
    rec = d.select(
        "doc_id",
        F.when(F.col("n_chars") % 10 == 0, "v0.9").otherwise("v1.0").alias("declared_version"),
        F.when(F.col("n_chars") % 4 != 0, "v1.0").alias("chunked_version"),
    )
    current = md.version_token(F.lit("v1.0 2026-07-13"))
    return md.version_drift(rec).withColumn("in_index", F.coalesce(F.col("chunked_version") == current, F.lit(False)))


SQL_COUNTS = """SELECT 'metadata-vs-chunks' AS "check", doc_id, problem FROM (SELECT coalesce(act.doc_id, rec.doc_id) AS doc_id,
      CASE WHEN a IS NULL THEN 'recorded ' || r || ' but no chunks exist' WHEN r IS NULL THEN a || ' chunks but no chunking block'
           WHEN a <> r THEN 'recorded ' || r || ' but found ' || a END AS problem FROM act FULL OUTER JOIN rec USING (doc_id)) WHERE problem IS NOT NULL"""
SQL_COUNTED = f"""{c.SQL_DOCS}, {c.SQL_CHUNKS}, act AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS a FROM chunks WHERE n_chars % 17 <> 0 GROUP BY doc_id),
    rec AS (SELECT doc_id, CAST(CASE WHEN n_chars % 5 = 0 THEN n + 1 ELSE n END AS INTEGER) AS r FROM (SELECT doc_id, n_chars, count(*) AS n FROM chunks GROUP BY doc_id, n_chars) WHERE n_chars % 19 <> 0)"""


def recorded_and_actual_chunks(spark, sf):
    """Recorded and actual chunk counts, with losses put in by document length."""
    n = ck.window_count("n_chars")
    actual = ck.chunks_per_document(ck.chunk_documents(c.documents(spark, sf).where("n_chars % 17 <> 0")))
    recorded = c.table(spark, sf, "documents").where((F.col("n_chars") % 19 != 0) & (n > 0)).select(
        "doc_id", F.when(F.col("n_chars") % 5 == 0, n + 1).otherwise(n).cast("int").alias("total_chunks")
    )
    return recorded, actual


@register("chunk_counts_reconcile", f"WITH {SQL_COUNTED} {SQL_COUNTS}")
def chunk_counts_reconcile(spark, sf):
    return rc.counts("metadata-vs-chunks", *recorded_and_actual_chunks(spark, sf))


@register(
    "reconcile_surfaces",
    f"""WITH {SQL_DECL}, {SQL_COUNTED}, real AS (SELECT doc_id FROM decl WHERE NOT starts_with(sha256, 'REPLACE_ME')), acq AS (SELECT doc_id FROM decl WHERE file_sha256 IS NOT NULL),
    inc AS (SELECT doc_id FROM labels WHERE quality = 1), meta AS (SELECT doc_id FROM labels WHERE toxic = 0), der AS (SELECT doc_id * 2 AS doc_id FROM documents WHERE n_chars % 2 = 0)
    SELECT 'declared-vs-acquired' AS "check", doc_id, 'declared but not acquired' AS problem FROM real WHERE doc_id NOT IN (FROM acq)
    UNION ALL SELECT 'declared-vs-acquired', doc_id, 'acquired but not declared' FROM acq WHERE doc_id NOT IN (FROM real)
    UNION ALL SELECT 'included-vs-metadata', doc_id, 'included but no metadata' FROM inc WHERE doc_id NOT IN (FROM meta)
    UNION ALL SELECT 'included-vs-metadata', doc_id, 'metadata but not included' FROM meta WHERE doc_id NOT IN (FROM inc)
    UNION ALL SELECT 'derived-vs-declared', doc_id, 'derived checksum but not declared' FROM der WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL FROM ({SQL_COUNTS})""",
)
def reconcile_surfaces(spark, sf):
    d = declared(spark, sf)
    lab = c.table(spark, sf, "labels")
    docs = c.table(spark, sf, "documents")
    recorded, actual = recorded_and_actual_chunks(spark, sf)
    return rc.reconcile(
        declared=d.where(dc.has_real_hash()),
        acquired=d.where("file_sha256 is not null"),
        included=lab.where("quality = 1"),
        metadata=lab.where("toxic = 0"),
        derived=docs.where("n_chars % 2 = 0").select((F.col("doc_id") * 2).alias("doc_id")),
        all_declared=docs,
        recorded_chunks=recorded,
        actual_chunks=actual,
    )


@register(
    "tag_coverage",
    f"""WITH {c.SQL_DOCS}, {c.SQL_CHUNKS} SELECT CAST(count(*) FILTER (len({c.sql_codes('text')}) > 0) AS BIGINT) AS with_tags, count(*) AS total FROM chunks""",
)
def tag_coverage(spark, sf):
    ch = c.chunks(spark, sf).select(tx.entity_codes("text", c.ENTITY_KEYWORDS).alias("tags"))
    return cv.tag_coverage(ch)


@register(
    "thin_evidence",
    f"""WITH {SQL_DECL}, r AS (SELECT DISTINCT doc_id, organization, unnest(topics) AS topic, country FROM (SELECT *, unnest([lang, org]) AS country FROM decl))
    SELECT topic, country, count(DISTINCT doc_id) AS n_docs, count(DISTINCT organization) AS n_orgs FROM r GROUP BY topic, country
    HAVING count(DISTINCT doc_id) = 1 OR count(DISTINCT organization) = 1""",
)
def thin_evidence(spark, sf):
    return cv.thin_evidence(declared(spark, sf).select("organization", "topics", "countries"))


@register(
    "coverage_contribution",
    f"""WITH {SQL_DECL}, f AS (SELECT organization, year, country, min(doc_id) AS doc_id FROM (SELECT doc_id, organization, left(publication_date, 4) AS year, unnest([lang, org]) AS country FROM decl) GROUP BY ALL)
    SELECT d.doc_id, count(f.doc_id) AS new_combinations, any_value(CAST(left(publication_date, 4) AS INTEGER) BETWEEN 2022 AND 2026 AND d.lang IN ('en', 'fr')) AS in_scope
    FROM decl d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
)
def coverage_contribution(spark, sf):
    d = declared(spark, sf).select("doc_id", "organization", "countries", "publication_date")
    scope = d.select("doc_id", cv.in_scope("publication_date", "countries", ("en", "fr")).alias("in_scope"))
    return cv.coverage_contribution(d).join(scope, "doc_id")
