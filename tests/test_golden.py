"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from provena.functions import ranking as rk
from provena.functions import text as tx
from provena.operators import acquisition as aq
from provena.operators import chunking as ck
from provena.operators import citations as cit
from provena.operators import claims as cl
from provena.operators import evaluate as ev
from provena.operators import metadata as md
from provena.operators import pages as pg
from provena.operators import prompts as pr
from provena.operators import quality as ql
from provena.operators import release as rl
from provena.operators import review as rv
from provena.operators import sampling as sm
from provena.operators import scope as sc
from provena.operators import search as se


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "n,size,step,want",
    [
        (0, 10, 5, []),
        (5, 10, 5, [(0, 5)]),
        (25, 10, 5, [(0, 10), (5, 15), (10, 20), (15, 25)]),
        (23, 10, 5, [(0, 10), (5, 15), (10, 20), (15, 23)]),
        (20, 10, 10, [(0, 10), (10, 20)]),
        (8, 5, 10, [(0, 5)]),
    ],
)
def test_windows(spark, n, size, step, want):
    got = one(spark, ck.windows("n", size, step), n=n)
    assert [(w["char_start"], w["char_end"]) for w in got] == want


def test_chunks_are_slices_of_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(4000)) + "é𝄞ü" * 20
    rows = ck.chunk_documents(spark.createDataFrame([("d", text), ("e", "")], "doc_id string, text string")).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {"d"}
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] for r in rows)
    assert rows[-1]["char_end"] == len(text) and rows[0]["chunk_id"] == "d-chunk-0000" and rows[0]["total_chunks"] == len(rows)


def test_neighbors(spark):
    df = spark.createDataFrame([("a-chunk-0000",), ("a-chunk-0009",), ("a-chunk-9999",), ("x",)], "c string")
    got = [r[0] for r in df.select(ck.neighbor_chunk_ids("c")).collect()]
    assert got == [["a-chunk-0001"], ["a-chunk-0008", "a-chunk-0010"], ["a-chunk-9998", "a-chunk-10000"], []]


def legs(spark, *lists):
    return [
        spark.createDataFrame([("q", cid, i) for i, cid in enumerate(ids, 1)], "query_id string, chunk_id string, rank int")
        for ids in lists
    ]


def test_fusion(spark):
    out = se.fuse(legs(spark, "abc", "ca"), 10, None).orderBy("rank").collect()
    want = {"a": 1 / 11 + 1 / 12, "b": 1 / 12, "c": 1 / 13 + 1 / 11}
    assert {r["chunk_id"]: pytest.approx(r["score"]) for r in out} == want
    assert [r["chunk_id"] for r in out] == ["a", "c", "b"]
    assert se.fuse(legs(spark, "abcde", "a"), 10, 2).count() == 2
    assert se.fuse(legs(spark, "", ""), 10, 5).count() == 0


def test_fusion_ties_keep_first_seen_order(spark):
    out = se.fuse(legs(spark, "xb", "yc"), 60, None).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["x", "y", "b", "c"]


@pytest.mark.parametrize("detected,want", [(["KE"], [2, 3, 1, 4]), ([], [1, 2, 3, 4]), (["ET"], [1, 2, 3, 4])])
def test_boost(spark, detected, want):
    rows = [("q", "1", ["TZ"], 1), ("q", "2", ["KE"], 2), ("q", "3", ["KE", "UG"], 3), ("q", "4", None, 4)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, tags array<string>, rank int")
    df = df.withColumn("detected", F.array(*[F.lit(d) for d in detected]).cast("array<string>"))
    assert [int(r["chunk_id"]) for r in se.boost(df).orderBy("rank").collect()] == want


def test_unknown_method_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown method"):
        se.legs(None, None, 5, None, "bm25")


def test_categories(spark):
    df = spark.createDataFrame(
        [(["KE", "UG"], "OONI", "x"), (["KE"], "OONI", "the OONI Probe"), (["KE"], "OONI", "x"), (["KE"], "Other", "methodology")],
        "c array<string>, o string, t string",
    )
    got = [r[0] for r in df.select(sc.chunk_category(F.col("c"), F.col("o"), F.col("t"))).collect()]
    assert got == ["multi_country", "ooni_methodology", "general", "general"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_out_of_scope_and_disclosure(spark, n):
    text = {1: "About Nigeria", 2: "Nigeria and Niger", 3: "Mali, Somalia and the DRC or Congo"}[n]
    names = {1: ["Nigeria"], 2: ["Nigeria", "Niger"], 3: ["Somalia", "the Democratic Republic of Congo", "Mali"]}[n]
    assert one(spark, sc.out_of_scope("t"), t=text) == names
    note = one(spark, sc.disclosure(F.array(*[F.lit(x) for x in names])))
    head = {1: "Note: Nigeria is ", 2: "Note: Nigeria and Niger are ", 3: "Note: Somalia, the Democratic Republic of Congo and Mali are "}[n]
    assert note.startswith(head)
    assert one(spark, sc.out_of_scope("t"), t="Kenya and Uganda") == []


RETRIEVED = "retrieved array<struct<rank:int,chunk_id:string,doc_id:string,pages:array<int>>>"


def parsed(spark, answer, n=5):
    r = [(i, f"c{i}", f"d{i}", None) for i in range(1, n + 1)]
    df = spark.createDataFrame([("q", answer, r)], f"question_id string, answer_markdown string, {RETRIEVED}")
    return cit.parse_citations(df)


def test_citations(spark):
    r = parsed(spark, "One [3]. Two [1]. Three [3] [7] [9] [7].\n\n  No marker \n\n [12]\n\n").first()
    assert [(c["marker"], c["chunk_id"]) for c in r["citations"]] == [(1, "c1"), (3, "c3")]
    assert r["invalid_markers"] == [7, 9, 12] and r["unsupported_paragraphs"] == ["No marker"]
    assert parsed(spark, "x [1]", 0).first()["invalid_markers"] == [1]
    huge = parsed(spark, "x [99999999999999999999999]").first()
    assert huge["citations"] == [] and huge["invalid_markers"] == [-1]


def meta(spark):
    rows = [("d1", "A", "T1", "2023-01-01", "u1"), ("d2", "A", "T2", "2025-01-01", "u2"), ("d3", "B", "T3", "2024-05-01", "u3")]
    return spark.createDataFrame(rows, "doc_id string, organization string, title string, publication_date string, url string")


@pytest.mark.parametrize(
    "answer,orgs,docs,status,part",
    [
        ("none", 0, 0, "none", "no citations"),
        ("[1]", 1, 1, "thin", "single document (from A)"),
        ("[1][2]", 1, 2, "single_org", "across 2 reports (2023-2025)"),
        ("[1][3]", 2, 2, "broad", "2 documents from 2 organizations (2023-2024)"),
        ("[4][5]", 0, 2, "broad", "2 documents from 0 organizations (date unknown)"),
    ],
)
def test_sourcing(spark, answer, orgs, docs, status, part):
    p = parsed(spark, answer)
    r = cit.sourcing(p, cit.citation_rows(p), meta(spark)).first()
    assert (r["distinct_orgs"], r["distinct_docs"], r["sourcing_status"]) == (orgs, docs, status) and part in r["footer"]


def test_source_lines(spark):
    p = parsed(spark, "[4] [1]")
    assert cit.source_lines(cit.citation_rows(p), meta(spark)).first()["sources"] == (
        '[1] A, "T1" (2023-01-01). u1\n[4] d4 (metadata unavailable), chunk c4.'
    )


def test_claims(spark):
    text = "It rose 3.5 percent.[4][4] [7] Plain! Also 1.2.3 held [2]. Tail without stop [1]"
    rows = cl.extract_claims(parsed(spark, text)).orderBy("claim_index").collect()
    assert [(r["claim_text"], r["markers"]) for r in rows] == [
        ("It rose 3.5 percent.[4][4] [7]", [4]), ("Also 1.2.3 held [2].", [2]), ("Tail without stop [1]", [1]),
    ]
    assert one(spark, cl.judgment_id(F.lit("q"), F.lit(7), F.lit("A"))) == "q::A::claim007"


@pytest.mark.parametrize(
    "raw,verdict",
    [
        ('```json\n{"verdict": "Partial", "reason": "x"}\n```', "partial"),
        ('{"verdict": "supported"}', "supported"),
        ("I think it is UNSUPPORTED, not supported", "unsupported"),
        ("seems supported", "supported"),
        ("no idea", "unsupported"),
    ],
)
def test_verdicts(spark, raw, verdict):
    assert one(spark, pr.parse_verdict("r"), r=raw)["verdict"] == verdict
    assert one(spark, pr.parse_verdict("r"), r="no idea")["reason"].startswith("[unparseable")


def test_answer_section(spark):
    for h in ("ANSWER", "## **Answer**:", "answer :"):
        assert one(spark, pr.answer_section("r"), r=f"PHASE\n{h}\n\n text [1]\n") == "text [1]"
    assert one(spark, pr.answer_section("r"), r="The ANSWER is x") is None


def test_unpack_excerpts(spark):
    assert one(spark, pr.unpack_excerpts("r"), r='["a", "b"]') == "--- excerpt 1 ---\na\n\n--- excerpt 2 ---\nb"
    assert one(spark, pr.unpack_excerpts("r"), r="plain") == "plain"


def test_cost(spark):
    df = spark.createDataFrame([("gpt-5.4-mini", 2000, 500), ("gpt-5.4-mini", 0, 0)], "model string, p int, c int")
    assert [r[0] for r in df.select(rv.cost_usd("model", "p", "c")).collect()] == [pytest.approx(0.001), 0.0]
    with pytest.raises(rv.UnknownModelError, match="other"):
        rv.require_known_models(df.withColumn("model", F.lit("other")))


def test_kappa_undefined_when_all_agree_on_one_verdict(spark):
    rows = [(str(i), "supported", "supported") for i in range(12)] + [("x", "partial", "")]
    r = rv.agreement(spark.createDataFrame(rows, "judgment_id string, verdict string, human_verdict string")).first()
    assert r["kappa"] is None and r["n_scored"] == 12 and r["n_missing"] == 1 and r["go"]


def test_precision_is_null_when_nothing_is_judged(spark):
    none = spark.createDataFrame([("general", "pending")], "category string, verdict string")
    assert rv.citation_precision(none).where("category = 'overall'").first()["precision"] is None


def test_largest_remainder_is_exact(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(23)], "id int, s string")
    sizes = {r["s"]: r["n_take"] for r in sm.largest_remainder_sizes(df, "s", 10, "id").collect()}
    assert sum(sizes.values()) == 10
    assert sm.largest_remainder(df, "s", "id", 10, "id").count() == 10


def test_hashed_rank_equals_a_plain_window(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "big").otherwise("small"))
    key = F.col("id").cast("string")
    got = {r["id"]: r["rank"] for r in rk.hashed_rank(df, key, ["g"], prefix=1).collect()}
    import hashlib

    for g, ids in (("big", range(400)), ("small", range(400, 500))):
        want = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [got[i] for i in want] == list(range(1, len(want) + 1)), g


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, ""), ("d", 3, "bbb")], "doc_id string, page int, text string")
    marks = pg.page_breakpoints(pages)
    assert [(r["page"], r["char_start"], r["char_end"]) for r in marks.orderBy("page").collect()] == [(1, 0, 4), (3, 6, 9)]
    r = pg.assemble_pages(pages).first()
    assert r["text"] == "aaaa\n\nbbb" and len(r["breakpoints"]) == 2
    ch = spark.createDataFrame([("d", "gap", 4, 6), ("d", "both", 3, 7), ("e", "none", 0, 5)], "doc_id string, chunk_id string, char_start int, char_end int")
    got = {x["chunk_id"]: x["pages"] for x in pg.chunk_pages(ch, marks, width=2).collect()}
    assert got == {"gap": None, "both": [1, 3], "none": None}


def test_format_checks(spark):
    check = lambda content, fmt, title="": one(spark, ql.format_problem("c", "f", "t"), c=content, f=fmt, t=title)
    assert check("%PDF-1.7", "pdf") is None and "magic" in check("<html>", "pdf")
    assert "just a moment" in check("<p>Just a Moment</p>", "html")
    assert check("<p>Uganda: shutdown of 2026!</p>", "html", "The Shutdown in Uganda 2026") is None
    assert "kenya" in check("<p>x</p>", "html", "Kenya on x")
    assert check('{"incident": {"text": "Body of report"}}', "json", "Body report") is None
    assert check("{oops", "json") == "not valid JSON" and "non-empty" in check('{"incident": {}}', "json")
    assert check("anything", "txt") is None


def test_acquisition_ladder(spark):
    cols = "doc_id string, sha256 string, acquisition string, raw_bytes_stable boolean, derived_sha256 string, file_sha256 string, format_problem string"
    rows = [
        ("1", "REPLACE_ME", "auto", True, None, "h", None), ("2", "h", "auto", True, None, "h", None),
        ("3", "h", "manual", True, None, "x", None), ("4", "h", "auto", True, None, "x", None),
        ("5", "h", "manual", True, None, None, None), ("6", "h", "auto", True, None, None, None),
        ("7", "REPLACE_ME", "auto", False, None, "h", None), ("8", "REPLACE_ME", "auto", False, None, "h", "bad"),
        ("9", "REPLACE_ME", "auto", False, "h", "h", None), ("10", "h", "auto", True, None, "h", "bad"),
    ]
    got = {r["doc_id"]: r["state"] for r in aq.acquisition_states(spark.createDataFrame(rows, cols)).collect()}
    assert got == {
        "1": "failed", "2": "present", "3": "failed", "4": "refetch", "5": "pending", "6": "fetch",
        "7": "bootstrapped", "8": "failed", "9": "present", "10": "failed",
    }


def test_supersession_cycle_is_an_error(spark):
    ok = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 3)], "doc_id bigint, superseded_by bigint")
    got = {r["doc_id"]: (r["current_doc"], r["depth"]) for r in md.resolve_supersession(ok).collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 1), 9: (4, 2)}
    with pytest.raises(ValueError, match="cycle"):
        md.resolve_supersession(spark.createDataFrame([(1, 2), (2, 1)], "doc_id bigint, superseded_by bigint"), max_rounds=3)


def test_unknown_release_org_fails(spark):
    ch = rl.release_chunks(spark.createDataFrame([("nobody-1", "t", "u")], "doc_id string, text string, source_url string"))
    with pytest.raises(rl.UnknownTierError):
        rl.require_known_orgs(ch, rl.FULL_TEXT_LICENSES, rl.STRIPPED_ORGS)
    with pytest.raises(Exception, match="no release tier"):
        rl.tiers(ch).collect()


def test_budget(spark):
    per = spark.createDataFrame([(1, 40), (2, 0), (3, 5), (4, 100)], "query_id int, n_pairs bigint")
    rows = ev.spend_budget(per, 50).orderBy("query_id").collect()
    assert [(r["cap"], r["n_checked"], r["remaining"]) for r in rows] == [(12, 12, 50), (12, 0, 38), (19, 5, 38), (33, 33, 33)]


def test_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([("m", i, 1.0) for i in range(7)], "g string, id int, v double")
    r = ev.bootstrap_ci(df, ["g"], ["v"], "id", resamples=100).first()
    assert (r["n"], r["lo"], r["hi"]) == (7, 1.0, 1.0)


def test_text_helpers(spark):
    assert one(spark, tx.word_count("t"), t="  a b \n c ") == 3 and one(spark, tx.word_count("t"), t=" \n") == 0
    got = {x["term"]: x["tf"] for x in one(spark, tx.term_counts("t"), t="b Aa aa éé x éé aa")}
    assert got == {"aa": 3, "éé": 2}
    assert one(spark, tx.content_sha256("t"), t="a\r\nb\rc") == one(spark, F.sha2("t", 256), t="a\nb\nc")
    assert math.isclose(one(spark, ql.detect_language("t"), t="the cat and the dog")["confidence"], 0.6)
    assert one(spark, ql.detect_language("t"), t="")["language"] == "unknown"


def test_only_a_whole_json_object_is_a_verdict(spark):
    from provena.operators import prompts as pr

    raw = ['{"verdict": "partial", "reason": "r"} but really unsupported', "{'verdict': 'partial'}", '[{"verdict": "partial"}]',
           '{"verdict": "partial", "reason": 3}', '{"verdict": "Partial"}', "no word of it", '{"verdict": "partial"}, {"verdict": "partial"}']
    got = [tuple(r["v"]) for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(pr.parse_verdict("r").alias("v")).collect()]
    assert got == [("unsupported", raw[0]), ("partial", raw[1]), ("partial", raw[2]), ("partial", raw[3]), ("partial", ""),
                   ("unsupported", "[unparseable judge response] no word of it"), ("partial", raw[6])]
    raw = ["{'disagree': true}", '{"disagree": true} trailing', '```json\n{"disagree": true, "fact_compared": "date"}\n```', "[1]"]
    got = [tuple(r["d"]) for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(pr.parse_disagreement("r").alias("d")).collect()]
    assert got == [(False, "unparseable"), (False, "unparseable"), (True, "date"), (False, "unparseable")]


def test_json_is_whole(spark):
    from provena.functions.text import whole_json

    texts = {'{"a": 1}\n': True, " [1, 2] ": True, "null": True, "4754": True, '"x"': True, "4754 Ieein +1": False, "44.1 +1 (906)": False, "{} x": False,
             "null x": False, "1, 2": False, "1], [2": False, "1] x": False, "1,": False, "": False, "  ": False, "x": False, '"a': False}
    df = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    assert [r["t"] for r in df.where(whole_json("t").isNotNull() != F.col("want")).collect()] == []
    problem = ql.format_problem(F.lit("4754543480058766 Ieein +1 (559)"), F.lit("json"), F.lit("t"))
    assert spark.range(1).select(problem).first()[0] == "not valid JSON"


def test_missing_fields_keep_their_line(spark):
    from provena.operators import citations as cit
    from provena.operators import prompts as pr

    cites = spark.createDataFrame([(1, 1, 7, "7-chunk-0000", None), (1, 2, 8, "8-chunk-0000", None)], "question_id int, marker int, doc_id int, chunk_id string, pages array<int>")
    meta = spark.createDataFrame([(7, "org", None, None, None)], "doc_id int, organization string, title string, publication_date string, url string")
    assert cit.source_lines(cites, meta).first()["sources"] == '[1] org, "None" (None). None\n[2] 8 (metadata unavailable), chunk 8-chunk-0000.'
    found = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "o", "b")], "query_id int, rank int, organization string, text string")
    asked = spark.createDataFrame([(1, "q")], "query_id int, text string")
    assert pr.user_prompts(found, asked).first()["prompt"] == "Question: q\n\nExcerpts:\n\n[1] (organization: None)\na\n\n[2] (organization: o)\nb"


def test_null_keys_are_ranked_too(spark):
    from provena.functions.ranking import hashed_rank

    df = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    assert sorted(r["rank"] for r in hashed_rank(df, F.col("k")).collect()) == [1, 2, 3]


def test_an_index_is_built_once_for_each_version_and_content(spark, monkeypatch):
    from provena.operators import search as se

    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta")], "doc_id long, text string")
    first = se.shared_index(docs, "v7 2026-01-01", name="once").searchable().select("chunk_id", "norm").collect()
    with monkeypatch.context() as m:
        m.setattr(se.ChunkIndex, "store", lambda *_: pytest.fail("built again"))
        assert sorted(se.shared_index(docs.repartition(3), "v7", name="once").searchable().select("chunk_id", "norm").collect()) == sorted(first)
        with pytest.raises(pytest.fail.Exception):
            se.shared_index(docs.limit(1), "v7", name="once")
    config = spark.createDataFrame([("hybrid", 10)], "method string, rrf_k int")
    q = spark.createDataFrame([(1, "beta delta")], "query_id long, text string")
    index = se.shared_index(docs, "v7", name="once")
    assert se.search(index, q, config=config).first()["score"] == pytest.approx(2 / 11)
    assert se.search(index, q).first()["score"] == pytest.approx(2 / 61)


def test_a_registry_refuses_a_stale_index(spark, tmp_path, monkeypatch):
    from provena.operators import search as se

    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta")], "doc_id long, text string")
    more = docs.union(spark.createDataFrame([(3, "delta delta epsilon")], docs.schema))
    q = spark.createDataFrame([(1, "delta")], "query_id long, text string")
    registry = se.IndexRegistry(spark, str(tmp_path / "r"))

    def found(d, version):
        return [r["doc_id"] for r in se.search(registry, q, method="text", docs=d, corpus_version=version).orderBy("rank").collect()]

    with pytest.raises(se.StaleIndexError, match="no index"):
        found(docs, "v1")
    assert registry.stamp().isEmpty()
    registry.publish(docs, "v1 2026-01-01")
    assert found(docs, "v1") == ["2"]
    stamp = registry.stamp().first()
    assert (stamp["corpus_version"], stamp["embedding_dim"], stamp["chunk_count"], stamp["embedding_model"]) == ("v1", 64, 2, "hashed-tfidf")
    with pytest.raises(se.StaleIndexError, match="built against"):
        found(docs, "v2 2026-02-01")
    with pytest.raises(se.StaleIndexError, match="have changed"):
        found(more, "v1")
    with pytest.raises(ValueError, match="docs and corpus_version"):
        se.search(registry, q)
    # two writers at once: the second finds the first one's entry and takes it
    rival = se.IndexRegistry(spark, str(tmp_path / "r"))
    store, raced = se.ChunkIndex.store, []

    def slow(self, path):
        out = store(self, path)
        if not raced:
            raced.append(path)
            rival.publish(more, "v2")
        return out

    monkeypatch.setattr(se.ChunkIndex, "store", slow)
    registry.publish(more, "v2")
    assert found(more, "v2") == ["3", "2"] and len(registry._entries.numbers()) == 2
    assert not (tmp_path / "r" / raced[0].split("/r/")[1]).exists()
    assert len(registry.expire()) == 1 and len(list((tmp_path / "r" / "indexes").iterdir())) == 1
    assert found(more, "v2") == ["3", "2"]
