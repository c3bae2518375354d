"""The kernels of the decontamination against their plain forms: counted pairs of terms, and the windows that hold enough of an item."""

import numpy as np

from provena.llm.decontamination import Decontamination, Bench, count_pairs, held_enough, lookup
from provena.llm.kernels import PUNCT, U64, Words


def texts_as_words(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), PUNCT)


def test_counted_pairs_are_the_product_of_the_passages():
    rng = np.random.default_rng(1)
    passage = np.sort(rng.integers(0, 40, 500)) * 7
    t = rng.integers(0, 30, 500)
    together = np.zeros((30, 30), np.int32)
    count_pairs(together, t, passage)
    held = np.zeros((300, 30))
    np.add.at(held, (passage, t), 1)
    assert (together + together.T + np.diag(np.bincount(t, minlength=30)) == held.T @ held).all()


def test_no_window_that_holds_enough_of_an_item_is_left_out():
    rng = np.random.default_rng(2)
    for length in (8, 11, 22, 64):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (0, 1, 5, 90, 300, 33, 700)]
        words = texts_as_words(texts)
        hop, need = max(length // 8, 1), 0.6 * length * 0.4
        every = np.flatnonzero(rng.random(len(words.hash)) < 0.7).astype(np.int32)
        mine = rng.random(len(every)) < 0.3
        places, want = every[mine], []
        for d in range(len(texts)):
            for start in range(words.first[d], words.first[d + 1], hop):
                left, right = max(start - 2 * hop, words.first[d]), min(start + length + 2 * hop, words.first[d + 1])
                if ((places >= left) & (places < right)).sum() >= need:
                    want.append(start)
        found = held_enough(words, every, mine, length, need)
        assert want and set(want) <= set(found.tolist())
        assert ((found - words.first[words.doc[found]]) % hop == 0).all()


def test_words_whose_hashes_begin_alike_are_told_apart():
    vocabulary = np.sort(np.array([5, 6, 7, (9 << 48) + 1, (9 << 48) + 4, (65535 << 48) + 3], U64))
    h = np.array([6, 8, (9 << 48) + 4, (9 << 48) + 2, (65535 << 48) + 3, 5, 1 << 60], U64)
    at, term = lookup(h, vocabulary, np.arange(6))
    assert at.tolist() == [0, 2, 4, 5] and term.tolist() == [1, 4, 5, 0]


def test_an_item_of_which_nothing_need_stand_there_is_still_told_from_nothing(spark):
    docs = spark.createDataFrame([(0, "one two three four five six"), (1, "other words alone"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    found = Decontamination(min_overlap=0.0, min_answer=0.0).matches(docs, items).collect()
    assert [(r["key"], r["overlap"]) for r in found] == [(0, 1.0)]
    assert Bench.of([(0, "one two", None)], Decontamination()).terms == 2
