"""Which windows hold which passages, verbatim: a substring join by the rarest piece of every passage.

Passages travel, text stays: the pieces of a block of passages are counted over all windows in one pass; the rarest piece
of a passage is its anchor, and a second pass compares a passage only in windows that hold its anchor. Nothing is shuffled
by a piece, so a common one loads no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.ranking import query_blocks, union_all
from provena.operators.chunking import CHUNK_SIZE, CHUNK_STEP

# Characters of a piece; a shorter passage is a piece itself.
PIECE = 16
# Passages that travel at a time.
MAX_ROWS = 50_000
MAX_BYTES = 4 * 1024 * 1024
# Characters of windows looked at together: their hashes stay in a core's cache.
CHARS = 1 << 16
# One mark for each value of so many leading bits of a hash tells most pieces that nothing asks for.
MARK_BITS = 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_MARK_SHIFT = np.uint64(64 - MARK_BITS)


def piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` codes: of two runs of half the size, or of a shorter run and a code."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size == 1:
        return _mixed(codes ^ np.uint64(1))
    half = size // 2 if size % 2 == 0 else size - 1
    left = piece_hashes(codes, half)
    right = left[half:] if half * 2 == size else codes[half:]
    return _mixed(left[:n] + right[:n] * _ODD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h *= _STEP
    h ^= h >> np.uint64(29)
    return h


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), offsets


class Pieces:
    """The pieces of a block of passages: sorted distinct ``hash`` by length, numbered through."""

    def __init__(self, passages: list[str]):
        self.passages = passages
        self.by_size: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        size_of = np.array([min(len(p), PIECE) for p in passages], np.int64)
        total = 0
        for size in sorted({int(s) for s in size_of if s > 0}):
            held = [piece_hashes(codes_of([passages[i]])[0], size) for i in np.flatnonzero(size_of == size)]
            self.by_size[size] = np.unique(np.concatenate(held))
            self.first[size] = total
            total += len(self.by_size[size])
        self.total = total

    def of(self, passage: str) -> np.ndarray:
        """Numbers of the pieces of a passage."""
        size = min(len(passage), PIECE)
        return np.searchsorted(self.by_size[size], piece_hashes(codes_of([passage])[0], size)) + self.first[size]


def hits(texts: list[str], by_size: dict[int, np.ndarray], first: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, piece) of every known piece that a text holds, each pair once."""
    marks = {}
    for size, known in by_size.items():
        marks[size] = np.zeros(1 << MARK_BITS, bool)
        marks[size][known >> _MARK_SHIFT] = True
    for a, b in _stretches(texts):
        codes, offsets = codes_of(texts[a:b])
        row = np.repeat(np.arange(b - a), np.diff(offsets))
        for size, known in by_size.items():
            h = piece_hashes(codes, size)
            found = np.flatnonzero(marks[size][h >> _MARK_SHIFT])
            found = found[row[found] == row[found + size - 1]]
            at = np.minimum(np.searchsorted(known, h[found]), len(known) - 1)
            same = known[at] == h[found]
            pair = np.unique(row[found[same]] * len(known) + at[same])
            yield pair // len(known) + a, pair % len(known) + first[size]


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def holding(windows: DataFrame, passages: DataFrame, keep: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """(query_id, ``keep``...) of every window (``text``) that holds the passage (query_id, text) verbatim.

    A null or empty passage is in no window. Passages are measured and cut into blocks of bounded rows and bytes.
    """
    asked = passages.where(F.length("text") > 0).select("query_id", "text")
    out = [_held(windows, block, keep) for block in query_blocks(asked, "query_id", "text", MAX_ROWS, MAX_BYTES)]
    return union_all(out)


def windows_holding(
    docs: DataFrame, passages: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = CHUNK_SIZE, step: int = CHUNK_STEP
) -> DataFrame:
    """(query_id, ``keep``..., chunk_index) of every window of a text (see ``chunking.windows``) that holds the passage: ``holding``
    without cutting the windows, so that what two of them share is looked at once."""
    asked = passages.where(F.length("text") > 0).select("query_id", "text")
    out = [_held(docs, block, keep, (size, step)) for block in query_blocks(asked, "query_id", "text", MAX_ROWS, MAX_BYTES)]
    return union_all(out)


def _windows(text: str, passage: str, size: int, step: int) -> Iterator[int]:
    """The windows of a text that hold a passage, each once."""
    n = len(text)
    last = min(max(-(-(n - size) // step), 0) + 1, -(-n // step)) - 1
    at, first = text.find(passage), 0
    while at >= 0:
        first = max(first, -(-(at + len(passage) - size) // step))
        yield from range(first, min(at // step, last) + 1)
        first = max(first, at // step + 1)
        at = text.find(passage, first * step)  # up to there it lies in the same windows or fewer


def _held(windows: DataFrame, block: DataFrame, keep: tuple[str, ...], cut: tuple[int, int] | None = None) -> DataFrame:
    got = block.toArrow()  # a block of passages
    ids, texts = got.column("query_id").combine_chunks(), got.column("text").to_pylist()
    place = [T.StructField("chunk_index", T.IntegerType())] if cut else []
    schema = T.StructType([block.schema["query_id"], *(windows.schema[c] for c in keep), *place])
    if not texts:
        return windows.sparkSession.createDataFrame([], schema)
    pieces = Pieces(texts)
    by_size, first = pieces.by_size, pieces.first
    context = windows.sparkSession.sparkContext
    model = context.broadcast((by_size, first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, first = model.value
        for batch in batches:
            for _, piece in hits([t or "" for t in batch.column(0).to_pylist()], by_size, first):
                number, n = np.unique(piece, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n)], names=["piece", "n"])

    counted = windows.select("text").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(pieces.total, np.int64)
    n[counted.column("piece").to_numpy()] = counted.column("n").to_numpy()
    anchor: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        own = pieces.of(text)
        rarest = int(own[np.argmin(n[own])])
        if n[rarest]:  # a piece that is nowhere: nor is the passage
            anchor.setdefault(rarest, []).append(i)
    chosen = np.array(sorted(anchor), np.int64)
    sizes, firsts, at = {}, {}, 0
    for size, known in by_size.items():
        part = known[chosen[(chosen >= first[size]) & (chosen < first[size] + len(known))] - first[size]]
        if len(part):
            sizes[size], firsts[size] = part, at
            at += len(part)
    model = context.broadcast((sizes, firsts, [anchor[int(c)] for c in chosen], texts))
    kind = ids.type

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, asked, texts = model.value
        for batch in batches:
            windows_ = [t or "" for t in batch.column(0).to_pylist()]
            row, found, index = [], [], []
            for text, piece in hits(windows_, sizes, firsts):
                for t, p in zip(text.tolist(), piece.tolist(), strict=True):
                    for i in asked[p]:
                        for w in _windows(windows_[t], texts[i], *cut) if cut else [0] * (texts[i] in windows_[t]):
                            row.append(t)
                            found.append(i)
                            index.append(w)
            held = batch.take(pa.array(row, pa.int64()))
            where = [pa.array(index, pa.int32())] if cut else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *held.columns[1:], *where], names=plain.names)

    plain = T.StructType([T.StructField("_i", T.LongType()), *schema.fields[1:]])
    out = windows.select("text", *keep).mapInArrow(compare, plain)
    names = windows.sparkSession.createDataFrame(pa.table({"_i": pa.array(np.arange(len(texts))), "query_id": ids.cast(kind)}))
    return out.join(F.broadcast(names), "_i").select(*schema.names)  # a row per passage of the block
