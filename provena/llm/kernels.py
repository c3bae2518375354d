"""NumPy kernels on Arrow string columns: words, word hashes and runs. They work on bytes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text a kernel handles at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII that is neither letter nor digit parts words too; bytes above 0x7f belong to words.
PUNCT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, a null as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1, i + 1)
        yield i, min(j, n)
        i = j


_POWERS: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for texts up to the usual length."""
    if len(_POWERS[0]) >= n:
        return [p[:n] for p in _POWERS]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, CHUNK_BYTES + 1), base)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 4 * CHUNK_BYTES:
        _POWERS[:] = made
    return [p[:n] for p in made]


class Words:
    """The words of some texts: ``hash``, ``doc`` (row of the text), ``start`` and ``end`` (bytes), ``first`` (offsets by row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = True):
        n = len(data)
        if lower:
            data = LOWER[data]
        inside = ~breaks[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | begins[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | begins[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        power, back = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * back[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of ``size`` words; a shorter text has all its words as one."""
    count = np.diff(words.first)
    salt = mix(np.arange(1, size + 1).astype(U64))
    n = len(words.hash)
    out_h, out_d = [], []
    if n >= size:
        h = np.zeros(n - size + 1, U64)
        for k in range(size):
            h += mix(words.hash[k : n - size + 1 + k] ^ salt[k])
        same = words.doc[: n - size + 1] == words.doc[size - 1 :]
        out_h.append(mix(h[same]))
        out_d.append(words.doc[: n - size + 1][same])
    for d in np.flatnonzero((count > 0) & (count < size)):
        w = words.hash[words.first[d] : words.first[d + 1]]
        # the number of words is part of the value: a short text equals no shingle of a long one
        out_h.append(mix(np.add.reduce(mix(w ^ salt[: len(w)]), keepdims=True) ^ U64(len(w) << 8)))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def distinct_by_doc(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values by document, and the offsets of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal ``keys``, and where each run begins (and the last ends); input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = run_starts(table, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut).combine_chunks(), starts
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(run_starts(table, keys), table.num_rows)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Characters a character kernel handles at once; a longer text is handled alone.
CHUNK_CHARS = 1 << 20
_GRAM = U64(0x9DDFEA08EB382D69)


def text_pieces(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return pieces(offsets, limit)


def char_grams(texts: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, offsets by text) of all character n-grams of each size, in lower case, blanks at both ends included.

    Any character up to U+0020 counts as a blank. A text of n characters has n + 1 n-grams of each size, an empty one none.
    """
    pad = " " * max(sizes)
    low = [t.lower() for t in texts]
    length = np.array([len(t) for t in low], np.int64)
    joined = pad + pad.join(low) + pad
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    codes[codes < U64(0x20)] = U64(0x20)
    grams = np.where(length > 0, length + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(grams)])
    begin = len(pad) - 1 + np.concatenate([[0], np.cumsum(length + len(pad))[:-1]]) if len(low) else np.zeros(0, np.int64)
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], grams)
    top = len(codes) - max(sizes) + 1
    for size in sizes:
        h = np.full(top, U64(size))
        for k in range(size):
            h = (h + codes[k : k + top]) * _GRAM
            h ^= h >> U64(29)
        yield ((h[at] * _GRAM) >> U64(64 - bits)).astype(np.int32), offsets
