"""Collocations against brute force: lists that prune, ties, languages, odd texts; the query against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from provena.llm import collocations
from provena.llm import queries as q
from provena.llm.collocations import Collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, limit, least, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        have = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {
            p[i:j] for p, a in have.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and p[i:j] in have and 100 * a >= share * have[p[i:j]]
        }
        scored = []
        for p, a in have.items():
            if p not in gone:
                s, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, words, docs, langs):
    """Skewed words, phrases that repeat, phrases inside longer ones, pieces of every length."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"W{i}" if i % 3 else f"é{i}" for i in range(words)])
    phrases = [list(rng.choice(vocabulary, rng.integers(2, 7))) for _ in range(12)]
    rows = []
    for _ in range(docs):
        w = []
        for _ in range(int(rng.integers(0, 40))):
            w += phrases[int(rng.integers(12))] if rng.random() < 0.3 else [vocabulary[min(int(rng.zipf(1.5)) - 1, words - 1)]]
            if rng.random() < 0.1:
                w[-1] += str(rng.choice(list(".,\n")))
        rows.append((langs[int(rng.integers(len(langs)))], " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,words,limit,least,batch", [(0, 40, 3, 3, 8), (1, 15, 20, 2, 1000)])
def test_lists_that_prune(spark, seed, words, limit, least, batch):
    rows = corpus(seed, words, 150, ["a", "b", None])
    docs = spark.createDataFrame([(x, t, "n", 1) for x, t in rows], "lang string, text string, phrase string, i1 int")
    assert rows_of(Collocations(limit=limit, least=least, batch=batch, bits=12).mine(docs)) == plain(rows, limit, least)


def test_few_prefixes_are_expanded(spark, monkeypatch):
    """The bounds settle a short list without counting under most pairs."""
    rows = corpus(4, 150, 400, ["a"])
    seen = []
    real = collocations.extensions
    monkeypatch.setattr(collocations, "extensions", lambda blocks, nodes, *rest: seen.append(len(nodes)) or real(blocks, nodes, *rest))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(Collocations(limit=3, least=2, bits=12).mine(docs)) == plain(rows, 3, 2)
    pairs = Counter()
    for _, t in rows:
        for piece in re.split(r"[.,\n]", t.translate(LOWER)):
            w = piece.split()
            pairs.update(zip(w, w[1:]))
    assert sum(seen) < sum(a >= 2 for a in pairs.values()) / 4


def test_odd_rows(spark):
    rows = [(None, "A b. a B\ta  b!c"), ("und", "a b\x0ba b\x0c"), ("x", None), ("x", ""), ("x", ",;:"), (None, "a b " * 20000), ("y", "É é É é"), ("y", "É é É é")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    c = Collocations(limit=50, least=2, bits=12)
    assert rows_of(c.mine(docs)) == plain(rows, 50, 2)
    assert rows_of(c.mine(docs.limit(0))) == []
    assert rows_of(Collocations(least=10**6, bits=12).mine(docs)) == []


def test_counts_beyond_64_bits(spark):
    a, b = 9_000_000_000_000_000_000, 123_456_789_012_345_678
    df = spark.createDataFrame([(b, a)], "a long, l long").select(collocations.score("a", collocations._sum("l", "a")).alias("s"))
    assert df.first()["s"] == 2_000_000 * b // (a + b)


def test_equal_hashes_take_another_salt(spark, monkeypatch):
    """Two words of one hash are noticed and told apart under the next salt."""
    real = collocations._salted

    def colliding(salt):
        table = real(salt).copy()
        if salt == 0:
            table[ord("x")] = table[ord("y")]
        return table

    rows = [("a", "x z x z y z y z y z")] * 3 + [("a", "y z y z")]
    monkeypatch.setattr(collocations, "_salted", colliding)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert rows_of(Collocations(limit=9, least=2, bits=12).mine(docs)) == plain(rows, 9, 2)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = con.execute(q.SQL["op12_collocations"])
    names = [d[0] for d in got.description]
    want = sorted(tuple(r[names.index(c)] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.fetchall())
    assert rows_of(q.op12_collocations(spark, "/root/testdata/sf0.01")) == want


def test_matcher_finds_every_occurrence():
    rng = np.random.default_rng(0)
    ids = np.array([11, 22, 33, 44], np.int64)
    codes = rng.integers(0, 5, 400).astype(np.int32)
    nodes = np.array([[11, 22, 0], [22, 22, 0], [11, 22, 33], [33, 11, 22], [99, 11, 0]], np.int64)
    words = [None, *ids.tolist()]
    found = sorted((int(n), int(t)) for node, at, _ in collocations.Matcher(nodes).find(ids, codes) for n, t in zip(node, at))
    want = sorted(
        (k, t) for k, n in enumerate(nodes.tolist()) for t in range(len(codes))
        if [words[c] for c in codes[t : t + (2 if n[2] == 0 else 3)]] == [x for x in n if x]
    )
    assert found == want


def test_parts_share_out_the_counts(spark):
    """No row of counts is in two parts or in none, and no part holds most of them."""
    docs = spark.createDataFrame(corpus(5, 200, 200, ["a", "b"]), "lang string, text string")
    blocks = collocations.staged(collocations.encoded(docs, "lang", "text")).cache()
    every = collocations.Bitmap(np.full(1 << 9, 255, np.uint8), 12)
    whole = sorted(collocations.pair_counts(blocks, every).collect())
    parts = [collocations.pair_counts(blocks, every, k, 4).collect() for k in range(4)]
    assert sorted(sum(parts, [])) == whole and max(map(len, parts)) < 0.4 * len(whole)
