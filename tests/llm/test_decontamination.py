"""Decontamination on planted items: whichever windows the corpus is cut into, every copy is found."""

import numpy as np

from provena.llm.decontamination import Decontamination


def made(spark, n_items, texts_of, partitions=4, plain=300, seed=3, **options):
    """What is found, as {(doc, item)}, and what ``texts_of(items, words)`` planted, a list of (text, [item, ..]), behind ``plain`` texts."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(3, 4003)
    words = lambda n: " ".join(f"w{k}" for k in rng.choice(4000, n, p=p / p.sum()))
    items = [words(50) for _ in range(n_items)]
    planted = texts_of(items, words)
    texts = [t for t, _ in planted] + [words(300) for _ in range(plain)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["key"], r["item_id"]) for r in Decontamination(**options).matches(docs, bench).collect()}
    return found, {(d, i) for d, (_, held) in enumerate(planted) for i in held}


def test_items_listed_one_after_another_are_all_found(spark):
    def texts(items, words):
        rng = np.random.default_rng(4)
        lists = [rng.choice(len(items), 8, replace=False).tolist() for _ in range(60)]
        note = lambda: " ".join(f"n{k}" for k in rng.integers(1 << 40, size=rng.integers(1, 12)))
        return [(words(int(rng.integers(100))) + " " + " ".join(f"{items[i]} {note()}" for i in held), held) for held in lists]

    found, want = made(spark, 200, texts)
    assert found == want


def test_a_thousand_items_are_found_as_few_are(spark):
    found, want = made(spark, 1000, lambda items, words: [(f"{words(60)} {t} {words(60)}", [i]) for i, t in enumerate(items)][::4], plain=100)
    assert found == want


def test_a_passage_in_a_third_of_all_documents_is_found_in_small_partitions(spark):
    def texts(items, words):
        passage = f"{words(20)} {items[0]} {words(20)}"
        return [(f"{words(60)} {passage} {words(60)}", [0]) for _ in range(134)]

    found, want = made(spark, 5, texts, partitions=200, plain=266)
    assert found == want


def test_items_of_frequent_words_are_found_reworded(spark):
    def texts(items, words):
        rng = np.random.default_rng(5)
        out = []
        for i, item in enumerate(items):
            w = item.split()
            for k in rng.choice(44, 18, replace=False):
                w[k] = f"n{rng.integers(1 << 40)}"
            out.append((f"{words(60)} {' '.join(w)} {words(60)}", [i]))
        return out

    found, want = made(spark, 200, texts)
    # 36% of the words of an item replaced by rare ones: 199 of 200 at 0.25, 146 at 0.4
    assert found <= want and len(found) >= 0.99 * len(want)
