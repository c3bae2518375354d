"""Spelling variants: words one edit apart, by composing a vocabulary acceptor with a one-edit transducer and the acceptor again.

Words are dealt out by the state that their first half leads to from the initial state, and the same for the words
read backwards: an edit leaves one of the two halves whole, so both words of a pair meet in one such partition. Each
partition is minimised and composed inside a task; what leaves it is one row per word, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.session import written_table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols are code points.
_SYMBOLS = 1 << 21
#: Words and symbols composed at a time; a partition with more is composed alone.
BLOCK_WORDS = 20_000
BLOCK_CELLS = 1 << 21
#: Paths of the composition followed at a time.
PATHS = 1 << 20


@dataclass(frozen=True)
class Acceptor:
    """A minimal acceptor of words that have equal lengths below each root. Arcs are sorted by state and symbol.

    ``start[s]`` to ``start[s + 1]`` are the arcs of state ``s``; ``skipped`` is the number of words that the arcs before it in its state
    accept, so the sum of ``skipped`` along a path is the rank of its word below the root.
    """

    start: np.ndarray
    symbol: np.ndarray
    child: np.ndarray
    skipped: np.ndarray
    height: np.ndarray
    #: states and their rank offsets: one per root
    roots: np.ndarray


def fan(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0..count-1) for every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _numbered(parts: list[np.ndarray]) -> np.ndarray:
    """The same number for equal rows of the columns ``parts``."""
    out = parts[0]
    for p in parts[1:]:
        _, a = np.unique(out, return_inverse=True)
        _, b = np.unique(p, return_inverse=True)
        out = a * (int(b.max(initial=0)) + 1) + b
    return np.unique(out, return_inverse=True)[1]


def minimise(root: np.ndarray, symbols: np.ndarray, length: np.ndarray) -> Acceptor:
    """The minimal acceptor of sorted distinct rows (``root``, ``symbols`` padded with 0), all of one length below each root."""
    n_roots = int(root[-1]) + 1
    first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    node, size = root.copy(), n_roots
    parent, symbol, child = [], [], []
    depth_of, words = [np.zeros(n_roots, np.int64)], [np.bincount(root, minlength=n_roots)]
    for d in range(symbols.shape[1]):
        live = np.flatnonzero(length > d)
        at, s = node[live], symbols[live, d]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1])])
        ids = size + np.cumsum(new) - 1
        parent.append(at[new])
        symbol.append(s[new])
        child.append(ids[new])
        depth_of.append(np.full(int(new.sum()), d + 1))
        words.append(np.bincount(ids - size))
        node[live] = ids
        size += int(new.sum())
    parent, symbol, child, words = (np.concatenate(x) for x in (parent, symbol, child, words))
    of_root = np.zeros(size, np.int64)
    of_root[:n_roots] = length[first]
    for a, c in _levels(parent, child, depth_of):
        of_root[c] = of_root[a]
    height = of_root - np.concatenate(depth_of)
    # states of one height are equal when their arcs are: folded arc by arc, lowest height first
    by = np.lexsort((symbol, parent))
    parent, symbol, child = parent[by], symbol[by], child[by]
    start = np.searchsorted(parent, np.arange(size + 1))
    klass, n = np.zeros(size, np.int64), 1  # class 0: the final state
    order = np.argsort(height, kind="stable")
    cut = np.searchsorted(height[order], np.arange(int(height.max()) + 2))
    leader = [np.array([order[0]])]
    for h in range(1, len(cut) - 1):
        nodes = order[cut[h] : cut[h + 1]]
        degree = start[nodes + 1] - start[nodes]
        key = _numbered([degree])
        for k in range(int(degree.max())):
            has = degree > k
            arc = start[nodes[has]] + k
            part = np.zeros((2, len(nodes)), np.int64)
            part[0, has], part[1, has] = symbol[arc], klass[child[arc]] + 1
            key = _numbered([key, part[0], part[1]])
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        klass[nodes] = n + inverse
        leader.append(nodes[index])
        n += len(index)
    leader = np.concatenate(leader)
    row, k = fan(start[leader + 1] - start[leader])
    arc = start[leader][row] + k
    begin = np.searchsorted(row, np.arange(n + 1))
    upto = np.concatenate([[0], np.cumsum(words[child[arc]])])
    return Acceptor(begin, symbol[arc], klass[child[arc]], upto[:-1] - upto[begin[row]], height[leader], klass[:n_roots])


def _levels(parent: np.ndarray, child: np.ndarray, depth_of: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    for d in depth_of[1:]:
        yield parent[at : at + len(d)], child[at : at + len(d)]
        at += len(d)


def _common(a: Acceptor, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, arc of u, arc of v) of the symbols that both states of a pair read."""
    keys = _arc_keys(a)
    swap = (a.start[u + 1] - a.start[u]) > (a.start[v + 1] - a.start[v])
    small, large = np.where(swap, v, u), np.where(swap, u, v)
    row, k = fan(a.start[small + 1] - a.start[small])
    arc = a.start[small][row] + k
    want = large[row] * _SYMBOLS + a.symbol[arc]
    other = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[other] == want
    row, arc, other = row[hit], arc[hit], other[hit]
    return row, np.where(swap[row], other, arc), np.where(swap[row], arc, other)


def _arc_keys(a: Acceptor) -> np.ndarray:
    return np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)) * _SYMBOLS + a.symbol


def one_edit_pairs(a: Acceptor, same: np.ndarray, longer: np.ndarray, shorter: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Accepted pairs of the composition, as ranks of words: those below a root of ``same`` that differ in one symbol, and those below
    ``longer[i]`` that lose one symbol to be below ``shorter[i]``. ``begin`` is the rank of the first word below each root.

    A pair that several edits lead to comes several times.
    """
    starts: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def edited(u, v, i, j):
        for h in np.unique(a.height[u]):
            of = a.height[u] == h
            starts.setdefault(int(h), []).append((u[of], v[of], i[of], j[of]))

    # before the edit both acceptors read the same symbols
    s, i = a.roots[same], begin[same]
    while len(s):
        degree = a.start[s + 1] - a.start[s]
        row, k = fan(degree * degree)
        c, d = a.start[s][row] + k // degree[row], a.start[s][row] + k % degree[row]
        row, c, d = row[c < d], c[c < d], d[c < d]
        edited(a.child[c], a.child[d], i[row] + a.skipped[c], i[row] + a.skipped[d])
        row, k = fan(degree)
        arc = a.start[s][row] + k
        s, i = a.child[arc], i[row] + a.skipped[arc]
        inner = a.height[s] > 0
        s, i = s[inner], i[inner]
    s, t, i, j = a.roots[longer], a.roots[shorter], begin[longer], begin[shorter]
    while len(s):
        row, k = fan(a.start[s + 1] - a.start[s])
        arc = a.start[s][row] + k
        edited(a.child[arc], t[row], i[row] + a.skipped[arc], j[row])
        row, c, d = _common(a, s, t)
        s, t, i, j = a.child[c], a.child[d], i[row] + a.skipped[c], j[row] + a.skipped[d]
    if not starts:
        return
    # after it, too: pairs of states from the highest down, then without the dead ends from the lowest up
    n_states = len(a.start) - 1
    top = max(starts)
    pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * (top + 1)
    arcs: list[tuple[np.ndarray, ...]] = [()] * (top + 1)
    coming = np.zeros(0, np.int64)
    for h in range(top, -1, -1):
        pairs[h] = np.unique(np.concatenate([coming, *(x[0] * n_states + x[1] for x in starts.get(h, []))]))
        row, c, d = _common(a, pairs[h] // n_states, pairs[h] % n_states)
        coming = a.child[c] * n_states + a.child[d]
        arcs[h] = (row, a.skipped[c], a.skipped[d], coming)
    live = np.ones(len(pairs[0]), bool)
    graph: list[tuple[np.ndarray, ...]] = [()] * (top + 1)
    lives = [live]
    for h in range(1, top + 1):
        row, i, j, to = arcs[h]
        to = np.searchsorted(pairs[h - 1], to)
        keep = lives[h - 1][to]
        row = row[keep]
        graph[h] = (np.searchsorted(row, np.arange(len(pairs[h]) + 1)), i[keep], j[keep], to[keep])
        lives.append(np.bincount(row, minlength=len(pairs[h])) > 0)

    def walk(h, at, i, j):
        todo = [(h, at, i, j)]
        while todo:
            h, at, i, j = todo.pop()
            if h == 0:
                yield i, j
                continue
            first, di, dj, to = graph[h]
            count = first[at + 1] - first[at]
            if len(at) > 1 and count.sum() > PATHS:
                todo += [(h, at[part], i[part], j[part]) for part in (slice(0, len(at) // 2), slice(len(at) // 2, None))]
                continue
            row, k = fan(count)
            arc = first[at][row] + k
            todo.append((h - 1, to[arc], i[row] + di[arc], j[row] + dj[arc]))

    for h, given in starts.items():
        for u, v, i, j in given:
            at = np.searchsorted(pairs[h], u * n_states + v)
            ok = lives[h][at]
            if ok.any():
                yield from walk(h, at[ok], i[ok], j[ok])


def _near(batches: Iterator[pa.RecordBatch], ratio: int) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) of the words that have a near word in their partition; input is sorted by partition."""
    held: list[pa.RecordBatch] = []
    rows = cells = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        cells += batch.num_rows * (pc.max(batch.column("length")).as_py())
        if rows >= BLOCK_WORDS or cells >= BLOCK_CELLS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.column("part")[-1]
            cut = pc.index(table.column("part"), last).as_py()
            if cut:
                yield from _composed(table.slice(0, cut), ratio)
                table = table.slice(cut).combine_chunks()
            held = table.to_batches()
            rows, cells = table.num_rows, table.num_rows * pc.max(table.column("length")).as_py()
    if held:
        yield from _composed(pa.Table.from_batches(held), ratio)


def _composed(table: pa.Table, ratio: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    part = pc.dictionary_encode(table.column("part").combine_chunks()).indices.to_numpy()
    often = np.bincount(part)[part] > 1
    table, part = table.filter(pa.array(often)), part[often]
    if table.num_rows == 0:
        return
    words = table.column("word").to_pylist()
    length, m = table.column("length").to_numpy(), table.column("m").to_numpy()
    back = table.column("backward").to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(table.column("word")).to_numpy()] = np.arange(len(words))
    n = table.column("n").to_numpy()
    half = m // 2
    skip = np.where(back, m - half, half)
    # what follows the first half, in reading direction
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    row, k = fan(length - skip)
    at = np.cumsum(length) - length
    symbols = np.zeros((len(words), int((length - skip).max())), np.int64)
    symbols[row, k] = flat[at[row] + np.where(back[row], length[row] - 1 - skip[row] - k, skip[row] + k)]
    root = part.astype(np.int64) * 2 + (length > m)
    by = np.lexsort((*symbols.T[::-1], root))
    roots, root = np.unique(root[by], return_inverse=True)
    symbols, left = symbols[by], (length - skip)[by]
    begin = np.searchsorted(root, np.arange(len(roots)))
    longer = np.flatnonzero((roots % 2 == 1) & np.isin(roots - 1, roots))
    shorter = np.searchsorted(roots, roots[longer] - 1)
    a = minimise(root, symbols, left)
    back, n, rank = back[by], n[by], rank[by]
    near, form = np.zeros(len(by), np.int64), np.full(len(by), -1)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs i, j: counts, and the most frequent near word of each so far."""
        for x, y in ((i, j), (j, i)):
            np.add.at(near, x, 1)
            able = n[y] >= ratio * n[x]
            x, y = x[able], y[able]
            x, y = np.concatenate([x, x[form[x] >= 0]]), np.concatenate([y, form[x[form[x] >= 0]]])
            order = np.lexsort((rank[y], -n[y], x))
            x, y = x[order], y[order]
            best = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
            form[x[best]] = y[best]

    for i, j in _distinct(one_edit_pairs(a, np.flatnonzero(roots % 2 == 0), longer, shorter, begin), len(by)):
        lost = left[i] > left[j]
        # read backwards, a pair that shares the first half as well belongs to the other direction
        check = np.flatnonzero(back[i] & lost)
        shared = np.ones(len(check), bool)
        for k in range(int(left[j[check]].max(initial=0))):
            inside = left[j[check]] > k
            shared[inside] &= symbols[i[check[inside]], k + 1] == symbols[j[check[inside]], k]
        keep = np.ones(len(i), bool)
        keep[check[shared]] = False
        take(i[keep], j[keep])
    found = np.flatnonzero(near)
    at = by[found]
    target = np.where(form[found] >= 0, by[form[found]], 0)
    none = pa.array(form[found] < 0)
    word = table.column("word").combine_chunks()
    text = word.cast(pa.string())
    yield pa.RecordBatch.from_arrays(
        [
            text.take(pa.array(at)), pa.array(near[found]),
            pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(n[form[found]])),
            pc.if_else(none, pa.scalar(None, pa.string()), text.take(pa.array(target))),
        ],
        names=["word", "n_near", "form_n", "form"],
    )


def _distinct(pairs: Iterator[tuple[np.ndarray, np.ndarray]], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair once. A word has few partners, so the pairs seen stay in proportion to the words."""
    seen = [np.zeros(0, np.int64)]
    for i, j in pairs:
        seen.append(i * words + j)
        if sum(map(len, seen[1:])) > max(PATHS, len(seen[0])):
            seen = [np.unique(np.concatenate(seen))]
    key = np.unique(np.concatenate(seen))
    for at in range(0, len(key), PATHS):
        yield key[at : at + PATHS] // words, key[at : at + PATHS] % words


def _text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


@dataclass(frozen=True)
class SpellingVariants:
    """Groups the words of a corpus with the forms they are near to.

    ``min_length`` code points and ``min_count`` occurrences make a word; ``ratio`` times as frequent must a near word
    be to count as a word's form.
    """

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    #: one occurrence of a word in ``typo_every`` loses a letter, by a hash of document and word; 0: none
    typo_every: int = 97

    def vocabulary(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(word, n) of the words of all whole texts. A null text has none; a null key counts as an empty one; repeated rows count each.

        Counting is inside Spark: occurrences are combined in each task, so a frequent word is one row per task.
        """
        runs = docs.select(_text(key).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
        runs = runs.where(F.length("run") >= self.min_length).select("k", F.translate("run", UPPER, LOWER).alias("run"))
        word = F.col("run")
        if self.typo_every:
            h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
            at = F.pmod(h, F.length("run")).cast("int")
            cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + F.lit(2)))
            word = F.when(F.pmod(h, F.lit(self.typo_every)) == 0, cut).otherwise(word)
        counted = runs.select(word.alias("word")).where(F.length("word") >= self.min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return counted.where(F.col("n") >= self.min_count)

    def near(self, words: DataFrame) -> DataFrame:
        """(word, n_near, form_n, form): for the distinct ``words`` (word, n) that have a near word, how many, and the word's form."""
        length = F.length("word")

        def role(m: Column, backward: bool) -> Column:
            half = m - F.floor(m / 2).cast("int") if backward else F.floor(m / 2).cast("int")
            end = F.substring(F.col("word"), length - half + 1, half) if backward else F.substring(F.col("word"), F.lit(1), half)
            part = F.concat(F.lpad(m.cast("string"), 9, "0"), F.lit("<" if backward else ">"), end)
            return F.struct(part.alias("part"), m.cast("int").alias("m"), F.lit(backward).alias("backward"))

        roles = F.array(*[role(length - less, backward) for less in (0, 1) for backward in (False, True)])
        dealt = words.select("word", "n", F.explode(roles).alias("r")).where(F.col("r.m") >= 1)
        dealt = dealt.select("r.part", "r.m", "r.backward", length.alias("length"), "word", "n")
        ratio = self.ratio
        sorted_parts = dealt.repartition("part").sortWithinPartitions("part")
        rows = sorted_parts.mapInArrow(lambda batches: _near(batches, ratio), "word string, n_near long, form_n long, form string")
        best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f"))))
        merged = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        return merged.select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.f").alias("form"))

    def variants(self, words: DataFrame) -> DataFrame:
        """(word, form, root, n, n_near, form_n) of every one of the distinct ``words`` (word, n).

        Of equally frequent near words the smallest is the form. Forms are at least ``ratio`` times as frequent, so
        following them ends; each round of doubling is a written table.
        """
        words = written_table(words)
        table = written_table(words.join(self.near(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))))
        steps = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
        while True:
            onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
            joined = steps.join(onward, "root", "left")
            steps = written_table(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            if steps.where("moved").isEmpty():
                break
            steps = steps.drop("moved")
        out = table.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        return out.select("word", "form", "root", "n", "n_near", "form_n")
