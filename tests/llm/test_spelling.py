"""Words one edit apart against brute force, and the query against a plain version."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from provena.llm import queries as q
from provena.llm.spelling import SpellingVariants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, ratio=2):
    """word: (form, root, n, n_near, form_n), partners by deleting or masking one letter."""
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def counted(rows, min_length=5, min_count=3):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= min_length:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def rows_of(df):
    got = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(counted(rows))
    assert len(want) > 1000 and sum(f[0] is not None for f in want.values()) > 50
    assert rows_of(q.op11_spelling_variants(spark, SF)) == want


@pytest.mark.parametrize("letters,longest,words", [("ab", 9, 300), ("abcé", 6, 600), ("a", 40, 40), ("abcdefghij", 4, 700)])
def test_dense_vocabularies(spark, letters, longest, words):
    """Few letters: long runs of one letter, whole neighbourhoods, words of one letter, ties in frequency."""
    rng = np.random.default_rng(len(letters))
    made = {"".join(rng.choice(list(letters), rng.integers(1, longest + 1))) for _ in range(words)}
    n = {w: int(rng.integers(1, 9)) for w in made}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(SpellingVariants(min_length=1).variants(table)) == plain(n)


def test_blocks_and_paths_are_cut(spark, monkeypatch):
    from provena.llm import spelling

    rng = np.random.default_rng(5)
    n = {"".join(rng.choice(list("abc"), 7)): int(rng.integers(1, 50)) for _ in range(400)}
    for name, value in (("BLOCK_WORDS", 7), ("PATHS", 11)):
        monkeypatch.setattr(spelling, name, value)
    import pyarrow as pa

    rows = [("x", 7, False, 7, w, c) for w, c in sorted(n.items())]
    names = ["part", "m", "backward", "length", "word", "n"]
    table = pa.table({k: list(v) for k, v in zip(names, zip(*[("p" + w[:3], *r[1:]) for w, r in zip(sorted(n), rows)]))})
    got = Counter()
    for batch in spelling._near(iter(table.to_batches(max_chunksize=5)), 2):
        for w, c in zip(batch.column("word").to_pylist(), batch.column("n_near").to_pylist()):
            got[w] += c
    want = {w: sum(one_edit(w, v) and w[:3] == v[:3] for v in n) for w in n}
    assert got == Counter({w: c for w, c in want.items() if c})


def test_odd_rows(spark):
    """Null texts and keys, empty texts, repeated rows, clashing names, a very long run, an empty table."""
    rows = [(1, None), (None, "Straße straße STRAßE strasse"), (2, ""), (3, "häuser Häuser häuser hauser 漢字" * 2), (3, "häuser Häuser häuser hauser 漢字" * 2),
            (4, ("x" * 3000 + " ") * 4), (5, ("x" * 3001 + " ") * 9), (None, "strasse strasse")]
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    v = SpellingVariants()
    assert rows_of(v.variants(v.vocabulary(docs))) == plain(counted(rows))
    assert v.variants(v.vocabulary(docs.limit(0))).count() == 0
