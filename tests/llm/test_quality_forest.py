"""Rule statistics against a plain version, and the forest on labelled documents it has not learnt from."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provena.llm import quality_forest as qf
from provena.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] >= 2 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


ODD = [
    "", None, " \t\n", "a", "a b", "a b a b a b", "x y z x y z", "ééé ñ ñ 漢字", "one\none\n one\n\n\n", "a\x0bb\x0cc\rd",
    "# * $ % & | < > #", "same line here\nsame line here\nsame line here", "w " * 5000, "é" * 3000 + " " + "long word " * 2000,
]


def test_statistics_against_a_plain_version(spark):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    counts, features = qf.statistics(pa.array(texts, pa.string()))
    assert [tuple(c) for c in counts.tolist()] == [plain(t) for t in texts]
    assert np.isfinite(features).all() and len(features) == len(texts)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op13_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_documents(spark):
    """Learnt from four fifths of the labels; on the last fifth junk goes and clean text stays."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    judged = qf.train(docs, labels.where(~out)).judge(docs).where(~qf.base_failed())
    got = judged.join(labels.where(out), judged["key"] == labels["doc_id"]).groupBy("quality").agg(F.avg(F.col("typical").cast("double")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.1


def test_paths_of_a_tree_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    x[:, 2] = 0.0
    low, high = np.array([-5.0, -5, -1]), np.array([5.0, 5, 1])
    forest = qf.grow(x, low, high, 7, 64, 6, 3)

    def walk(row):
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(row[forest.feature[node]] >= forest.value[node])
            total += forest.path[node]
        return 2 ** -(total / 7 / float(qf.expected_path(64)))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    # a statistic that never varies among the examples still tells a stranger
    stranger = np.array([[0.0, 0.0, 0.9]])
    assert forest.score(stranger)[0] > forest.score(np.zeros((1, 3)))[0]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None), (1, 1), (1, 0), (3, 1)]])
def test_odd_rows_and_labels(spark, labels):
    """Nulls, repeated keys, clashing names, few or no labels and an empty table: one row per row."""
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = spark.createDataFrame([(i if i % 3 else None, t, "x", 0.5) for i, t in enumerate(ODD + ODD)], "doc_id long, text string, key string, anomaly double")
    rows = qf.train(docs, y).judge(docs).collect()
    assert sorted((r["key"] is None, r["n_words"]) for r in rows) == sorted((i % 3 == 0, plain(t)[0]) for i, t in enumerate(ODD + ODD))
    assert qf.train(docs.limit(0), y).judge(docs.limit(0)).count() == 0


def test_all_good_rows_set_the_threshold(spark):
    """However few rows the trees are drawn from, no loss means that every labelled good row stays."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    judged = qf.train(docs, labels, rows=20, trees=20, loss=0.0).judge(docs).where(~qf.base_failed())
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("y")).where("y = 1")
    rows = judged.join(good, judged["key"] == good["doc_id"]).select("typical").collect()
    assert len(rows) > 50 and all(r["typical"] for r in rows)


def test_order_statistic(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.random(500), np.full(40, 0.5), [0.0, 1.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for at in (0, 3, 260, 540, 541):
        assert qf.order_statistic(df, "v", at) == np.sort(values)[at]
