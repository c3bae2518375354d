"""Line dedup: content-defined chunks of lines; chunks that the corpus repeats are removed after their bytes are compared.

Lines: a text is cut at line breaks and after words where a hash of the last two words says so, so that a long paragraph is
a sequence of short lines too. Chunks: a rolling hash over the hashes of the last two lines closes a chunk where its value
meets a fixed pattern; a line break closes one always and starts the rolling hash afresh. The boundaries inside a passage
thus depend on nothing but the passage, wherever it stands.

Hashes of chunks are counted over the corpus; only chunks whose hash occurs again are shuffled with their bytes. An
occurrence goes if its bytes equal those of a chunk in an earlier document (the one with the smallest key keeps its own,
also where it repeats itself). A passage rarely begins and ends where chunks do: a run of such chunks is extended word by
word, on both sides, as far as the words equal those around it in that earlier document. A run goes if it then has two lines
and ``min_words`` words or more, so that short common lines are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.ranking import broadcast_if_small
from provena.llm.common import free
from provena.llm.kernels import U64, Words, mix, pieces, signed, utf8
from provena.session import discard, written_table

NEWLINE = ord("\n")
WORD = re.compile(rb"[^\x20\t-\r]+")


@dataclass(frozen=True)
class LineDedup:
    """min_words: words of a run of repeated chunks from which on it is removed. line_every: one word in so many may end a
    line, if neither of the two before may; chunk_every: one line in so many ends a chunk. filter_bits: of the bitmap that
    keeps most single chunks from being shuffled; it changes no result. reach: bytes around a run that an extension may
    cover on either side; they are at hand where the earlier document's own neighbouring chunk is not repeated."""

    min_words: int = 16
    line_every: int = 3
    chunk_every: float = 1.5
    filter_bits: int = 25
    reach: int = 256

    def clean(self, docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_words") -> DataFrame:
        """``docs`` with the repeated runs cut out of ``text`` and the number of words cut in ``removed``.

        Rows whose text repeats nothing come back as they are; a null text stays null, an empty one empty. A text of
        which nothing is left becomes empty. Equal keys with equal texts are one document: all of these rows get the same
        result. The first occurrence is the one in the smallest key; a null key comes last.
        """
        docs = docs.drop(removed)
        row = F.xxhash64(F.col(key).isNull(), F.col(key), text)
        spans = self.repeated(docs.select(row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
        # All columns travel in one struct, so that no name of theirs can meet one of these.
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), row.alias("row"), F.col(key).alias("key"))
        spans = spans.select(F.col("row").alias("cut_row"), F.col("key").alias("cut_key"), "spans")
        mine = (F.col("row") == F.col("cut_row")) & F.col("key").eqNullSafe(F.col("cut_key"))
        with_spans = whole.join(spans, mine, "left").select("d.*", F.col("spans").alias(free(docs, "spans")))
        at, min_words = docs.columns.index(text), self.min_words

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, cuts, gone = [], batch.column(batch.num_columns - 1).to_pylist(), []
                for t, spans in zip(batch.column(at), cuts, strict=True):
                    if not spans:
                        texts.append(t.as_py())
                        gone.append(0)
                        continue
                    raw, kept, last, words = t.as_buffer().to_pybytes(), [], 0, 0
                    for s, e, w in extended(raw, spans, min_words):
                        kept.append(raw[last:s])
                        last, words = e, words + w
                    left = b"".join([*kept, raw[last:]])
                    texts.append(left.decode("utf-8", "replace") if left.strip() or not words else "")
                    gone.append(words)
                columns = [*batch.columns[:-1], pa.array(gone, pa.int64())]
                columns[at] = pa.array(texts, batch.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], removed])

        return with_spans.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(removed, T.LongType())]))

    def repeated(self, rows: DataFrame) -> DataFrame:
        """(row, key, spans): the runs of repeated chunks in each row that has any: byte spans (s, e), words (w), lines (l), and
        the bytes before and after (pre, post) where the chunks occur first, or null. A staged table, the only one that is left."""
        min_words = self.min_words
        # Counting needs no text: one row for each chunk hash and task, then one for each hash.
        counts = self._chunks(rows).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
        often = written_table(counts)
        # What the bitmap lets through by chance goes below, where single chunks form groups of their own.
        found = written_table(self._chunks(rows, self._bitmap(often)))
        # Equal bytes make a group, whatever their hash; its first occurrence stays. Counted map-side, so that a chunk
        # in a third of all documents is one row per task.
        groups = written_table(_groups(found).select("hash", "first", "final"))
        # Where all chunks of a hash have the same bytes, the hash alone stands for them from here on; where not, the bytes do.
        clashing = written_table(groups.groupBy("hash").count().where("count > 1").select("hash"))
        clash = broadcast_if_small(clashing, 1_000_000)
        place = ["hash", "row", "key", "place", "s", "e", "w", "lines"]
        # written, so that Spark may split a hot chunk in the join
        first = groups.where("first.r <> final.r").join(clash, "hash", "left_anti").select("hash", "first")
        same = found.select(place).join(first, "hash")
        unlike = found.join(clash, "hash", "left_semi")
        named = _groups(unlike).where("first.r <> final.r").select("hash", "bytes", "first")
        same = same.unionByName(unlike.select(*place, "bytes").join(named, ["hash", "bytes"]).drop("bytes"))
        again = same.where(F.col("first.r") != F.col("row"))
        # The chunks of one document, in order; neighbours join to runs.
        chunk = ["place", "s", "e", "w", "lines", "pre", "post"]
        again = again.select("row", "key", *chunk[:5], "first.pre", "first.post")
        per_row = again.groupBy("row", "key").agg(F.sort_array(F.collect_set(F.struct(*chunk))).alias("c"))

        def run(s: Column, e: Column, w: Column, n: Column, pre: Column, post: Column) -> Column:
            return F.array(F.struct(s.alias("s"), e.alias("e"), w.alias("w"), n.alias("l"), pre.alias("pre"), post.alias("post")))

        def add(acc: Column, x: Column) -> Column:
            runs, top = acc["runs"], F.element_at(acc["runs"], -1)
            longer = run(top["s"], x["e"], top["w"] + x["w"], top["l"] + x["lines"], top["pre"], x["post"])
            new = run(x["s"], x["e"], x["w"], x["lines"], x["pre"], x["post"])
            joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), longer)
            return F.struct(x["place"].alias("last"), F.when(x["place"] == acc["last"] + 1, joined).otherwise(F.concat(runs, new)).alias("runs"))

        none = F.array().cast("array<struct<s:int,e:int,w:int,l:int,pre:binary,post:binary>>")
        runs = F.aggregate("c", F.struct(F.lit(-2).alias("last"), none.alias("runs")), add)["runs"]
        may = F.filter(runs, lambda r: ((r["w"] >= min_words) & (r["l"] >= 2)) | r["pre"].isNotNull() | r["post"].isNotNull())
        spans = written_table(per_row.select("row", "key", may.alias("spans")).where(F.size("spans") > 0))
        discard(often, found, groups, clashing)
        return spans

    def _bitmap(self, often: DataFrame) -> np.ndarray:
        """One bit for each hash value modulo 2 ** filter_bits: of fixed size, however many hashes there are."""
        bits = often.select(F.shiftrightunsigned("hash", 64 - self.filter_bits).alias("bit"))
        word = bits.groupBy(F.expr("cast(bit div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("m"))
        per = 1 << 15  # words of 32 bits in a segment; each is packed in one task, so that few rows reach the driver

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segments: dict[int, np.ndarray] = {}
            for batch in batches:
                w, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for seg in np.unique(w // per).tolist():
                    mine = w // per == seg
                    segments.setdefault(seg, np.zeros(per, np.uint32))[w[mine] % per] = m[mine].astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(segments), pa.int32()), pa.array([x.tobytes() for x in segments.values()], pa.binary())], names=["seg", "bits"]
            )

        dealt = word.repartition(F.expr(f"w div {per}")).select("w", "m")
        out = np.zeros(max((1 << self.filter_bits) // 32, per), np.uint32)
        for r in dealt.mapInArrow(packed, "seg int, bits binary").toLocalIterator():
            out[r["seg"] * per : (r["seg"] + 1) * per] = np.frombuffer(r["bits"], np.uint32)
        return out.view(np.uint8)

    def _chunks(self, rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
        """Chunks that ``wanted`` may hold as (hash, row, key, place, s, e, w, lines, bytes), or counts (hash, n) of all by task."""
        reach = self.reach
        line_every, chunk_every, shift = self.line_every, self.chunk_every, U64(64 - self.filter_bits)
        shared = rows.sparkSession.sparkContext.broadcast(wanted)

        def each(batch: pa.RecordBatch):
            data, offsets = utf8(batch.column(2))
            for a, b in pieces(offsets):
                piece = data[offsets[a] : offsets[b]]
                local = offsets[a : b + 1] - offsets[a]
                yield a, piece, local, chunk_bounds(piece, local, line_every, chunk_every)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in batches:
                held += [c[0] for *_, c in each(batch)]
                if sum(map(len, held)) > 2_000_000:
                    yield tally(held)
                    held = []
            yield tally(held)

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.unpackbits(shared.value, bitorder="little").view(bool)
            for batch in batches:
                for a, piece, local, chunks in each(batch):
                    may = known[(chunks[0] >> shift).astype(np.int64)]
                    # what surrounds a chunk is needed where its neighbour is not repeated itself
                    follows = np.append(False, chunks[1][1:] == chunks[1][:-1])[: len(may)]
                    ends_before = (~np.append(False, may[:-1])[: len(may)] & follows)[may]
                    ends_after = (~np.append(may[1:], False)[: len(may)] & np.append(follows[1:], False)[: len(may)])[may]
                    h, doc, place, s, e, w, lines, begin = (x[may] for x in chunks)
                    at = pa.array(a + doc)
                    raw, stop = piece.tobytes(), local[doc + 1]
                    pre = [before(raw, i, lo, reach) if x else None for x, i, lo in zip(ends_before, s.tolist(), begin.tolist(), strict=True)]
                    post = [after(raw, j, hi, reach) if x else None for x, j, hi in zip(ends_after, e.tolist(), stop.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(h)), batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int32()),
                         pa.array(s - begin, pa.int32()), pa.array(e - begin, pa.int32()), pa.array(w, pa.int32()), pa.array(lines, pa.int32()),
                         pa.array([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
                         pa.array(pre, pa.binary()), pa.array(post, pa.binary())],
                        names=["hash", "row", "key", "place", "s", "e", "w", "lines", "bytes", "pre", "post"])

        if wanted is None:
            return rows.mapInArrow(counted, "hash long, n long")
        kind = rows.schema["key"].dataType.simpleString()
        return rows.mapInArrow(listed, f"hash long, row long, key {kind}, place int, s int, e int, w int, lines int, bytes binary, pre binary, post binary")


def _groups(found: DataFrame) -> DataFrame:
    """(hash, bytes, first, final): the first and the last occurrence of every chunk, with what surrounds the first."""
    order = [F.col("key").isNull().alias("z"), F.col("key").alias("k"), F.col("row").alias("r")]
    return found.groupBy("hash", "bytes").agg(F.min(F.struct(*order, "pre", "post")).alias("first"), F.max(F.struct(*order)).alias("final"))


def before(raw: bytes, at: int, begin: int, reach: int) -> bytes:
    """The whole words in the ``reach`` bytes before ``at``."""
    lo = max(begin, at - reach)
    part = raw[lo:at]
    return part if lo == begin or raw[lo - 1 : lo].isspace() else WORD.sub(b"", part, 1)


def after(raw: bytes, at: int, end: int, reach: int) -> bytes:
    """The whole words in the ``reach`` bytes after ``at``."""
    hi = min(end, at + reach)
    part = raw[at:hi]
    return part if hi == end or raw[hi : hi + 1].isspace() else part[: max(part.rfind(x) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1]


def extended(raw: bytes, runs: list[dict], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, words) of the runs that go, in order: each grows over the words it shares with where it occurs first."""
    runs = sorted(runs, key=lambda r: r["s"])
    last = 0
    for r, following in zip(runs, [*(x["s"] for x in runs[1:]), len(raw)], strict=True):
        s, e, more = r["s"], r["e"], 0
        for m, word in zip(WORD.finditer(raw, e, following), WORD.findall(r["post"] or b""), strict=False):
            if m.group() != word:
                break
            e, more = m.end(), more + 1
        theirs = WORD.findall(r["pre"] or b"")
        lo = max(last, s - 2 * len(r["pre"] or b"") - 64)
        mine = [*WORD.finditer(raw, lo, s)]
        if mine and lo > last and not raw[lo - 1 : lo].isspace():
            mine = mine[1:]
        for m, word in zip(reversed(mine), reversed(theirs), strict=False):
            if m.group() != word:
                break
            s, more = m.start(), more + 1
        if r["w"] + more >= min_words and r["l"] + (more > 0) >= 2:
            yield s, e, r["w"] + more
            last = e


def tally(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n, pa.int64())], names=["hash", "n"])


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, line_every: int, chunk_every: float) -> tuple[np.ndarray, ...]:
    """(hash, doc, place, start, end, words, lines, start of the doc) of every chunk; bytes count from ``data``'s start.

    ``place`` numbers the chunks of a document. A chunk ends with its last word, so that blanks around a passage do not
    matter.
    """
    words = Words(data, offsets, lower=False)
    n = len(words.hash)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z, z, z, z, z
    breaks = np.concatenate([[0], np.cumsum(data == NEWLINE)])
    following = np.append(words.start[1:], len(data))
    hard = np.append(words.doc[1:] != words.doc[:-1], True) | (breaks[following] > breaks[words.end])
    # nothing before a line break is looked at
    fresh = np.append(True, hard[:-1])
    pair = mix(np.where(fresh, U64(0), np.append(U64(0), words.hash[:-1])) * U64(0x9E3779B97F4A7C15) + words.hash)
    may = pair % U64(line_every) == 0
    one = np.append(False, may[:-1]) & ~fresh
    two = np.append(False, one[:-1]) & ~fresh
    line_end = hard | (may & ~one & ~two)
    last = np.flatnonzero(line_end)  # the last word of each line
    first = np.append(0, last[:-1] + 1)
    line = ordered_sum(words.hash, first, last)
    before = np.append(U64(0), line[:-1])
    before[np.append(True, hard[last][:-1])] = 0
    rolling = mix(before * U64(0x9E3779B97F4A7C15) + line)
    at = np.flatnonzero(((rolling >> U64(40)) * chunk_every < 1 << 24) | hard[last])  # the last line of each chunk
    begin = np.append(0, at[:-1] + 1)
    w0, w1 = first[begin], last[at]
    doc = words.doc[w1]
    place = np.arange(len(at)) - np.searchsorted(doc, doc)
    return ordered_sum(line, begin, at), doc, place, words.start[w0], words.end[w1], w1 - w0 + 1, at - begin + 1, offsets[doc]


def ordered_sum(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each range of values that depends on their order: each is mixed with its distance from the end."""
    distance = (np.repeat(last, last - first + 1) - np.arange(len(value))).astype(U64)
    sums = np.concatenate([[U64(0)], np.cumsum(mix(value + mix(distance + U64(1))))])
    return mix(sums[last + 1] - sums[first])
