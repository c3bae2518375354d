"""Pieces of passages: what a scan of texts finds, against brute force, and hashes that do not depend on the place."""

import numpy as np
import pytest

from provena.operators import evaluate as ev
from provena.operators import passages as pa_
from provena.operators.chunking import chunk_documents


@pytest.mark.parametrize("chars", [50, 1 << 16])
def test_pieces_found_against_brute_force(monkeypatch, chars):
    monkeypatch.setattr(pa_, "CHARS", chars)
    rng = np.random.default_rng(5)
    letters = list("abé漢😀 ")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 200)]
    passages = ["".join(rng.choice(letters, int(n))) for n in range(1, 21)]
    pieces = pa_.Pieces(passages)
    number = {}
    for p in passages:
        size = min(len(p), pa_.PIECE)
        for i, k in enumerate(pieces.of(p).tolist()):
            assert number.setdefault(k, p[i : i + size]) == p[i : i + size]
    got = [(t, k) for a, b in pa_.hits(texts, pieces.by_size, pieces.first) for t, k in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == sorted((t, k) for t, text in enumerate(texts) for k, piece in number.items() if piece in text)


@pytest.mark.parametrize("size", range(1, 9))
def test_runs_that_differ_in_one_code_or_in_order_differ(size):
    codes, _ = pa_.codes_of(["abcdefgh" * 3, "hgfedcba", "abcdefgx"])
    runs = {tuple(codes[i : i + size].tolist()): h for i, h in enumerate(pa_.piece_hashes(codes, size).tolist())}
    assert len(set(runs.values())) == len(runs)
    assert all(h == runs[tuple(codes[i : i + size].tolist())] for i, h in enumerate(pa_.piece_hashes(codes, size).tolist()))


def test_windows_of_a_text_that_hold_a_passage():
    """Without cutting them: the same windows as a look at every one of them, each once."""
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n, size, step = (int(x) for x in rng.integers([0, 1, 1], [60, 20, 20]))
        text, passage = ("".join(rng.choice(list("ab"), k)) for k in (n, int(rng.integers(1, 8))))
        count = min(max(-(-(n - size) // step), 0) + 1, -(-n // step))
        want = [i for i in range(count) if passage in text[i * step : min(i * step + size, n)]]
        assert list(pa_._windows(text, passage, size, step)) == want


def test_gold_windows_are_the_gold_chunks(spark):
    filler = "漢字 😀 words of a text that goes on and on, "
    texts = [filler * 90 + "the passage" + filler * 60, "the passage", filler * 33 + "the pass" + filler, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the passage"), (2, "😀"), (3, filler * 40), (4, ""), (5, None), (6, "ge漢")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "chunk_id").collect()))
    want = rows(ev.gold_chunks(chunk_documents(docs), asked))
    assert rows(ev.gold_windows(docs, asked)) == want and {r[0] for r in want} == {1, 2, 6}
    assert "regexp_extract_all" not in ev.gold_windows(docs, asked)._jdf.queryExecution().optimizedPlan().toString()
