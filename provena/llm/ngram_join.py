"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures before exact sorted-array intersection.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents with equal sets form one class; only
classes are compared.

1. Two sets with Jaccard similarity t or more share one of the first ``n - ceil(t n) + 1`` shingles of each in any common
   order. Shingles that many documents hold come last in that order (a count over the whole corpus finds them), the rest
   follow their hash. Each class lists itself under these shingles.
2. Shingles that the same classes list, as those of a shared passage, count as one. A shingle and a size band make a tile: a
   band spans a factor 1/t of set sizes, so a class meets its own band and the next. A tile with many classes is cut into
   blocks, and pairs of blocks are tiles of their own.
3. In a tile, bit counts of the classes' bitmaps, which are as long as the sets are large, bound each pair's overlap from above. Classes without any partner left are
   dropped before arrays are made. Of the pairs that may link, a tile hands on a spanning forest, never all pairs; these are intersected exactly as sorted arrays, and links merge
   components. Tiles whose classes still lie in different components are gone through again, without the pairs found
   wanting and with more pairs a row, until no tile has a pair left that may link. Every pair is thus linked, refuted by its bits or its arrays, or
   already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small, union_all
from provena.llm.common import components
from provena.llm.kernels import U64, Words, distinct_by_doc, mix, pieces, shingle_hashes, signed, utf8, whole_runs
from provena.session import discard, written_table


@dataclass(frozen=True)
class JaccardJoin:
    """Link where ``overlap * den >= union * num``. The other parameters change the work, not the result.

    bits: least bits of a bitmap, a power of two. heavy_share: a shingle held by a larger share of the documents is ranked last. block: classes of
    a tile beyond which it is cut into blocks. first_keys: leading shingles whose tiles are gone through first. parts, part_rows: the
    listings are shuffled in up to so many parts, of so many rows at least, to find the shingles that several classes list.
    """

    size: int = 5
    num: int = 75
    den: int = 100
    bits: int = 1024
    heavy_share: float = 0.001
    max_heavy: int = 500_000
    block: int = 4096
    first_keys: int = 4
    parts: int = 4
    part_rows: int = 4_000_000

    def classes(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n, component): the size of each row's set and the smallest key reachable by links, itself included.

        A text without words has an empty set and links with nothing; a null text is an empty one. Rows that repeat a key
        are separate rows of one key. A null key is kept and never names a component of others.
        """
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        whole = written_table(self._listed(docs, self._heavy(docs)))
        rows = whole.agg(F.sum(F.size("shingles"))).first()[0] or 0
        parts = min(self.parts, 1 + rows // self.part_rows)
        met = [written_table(self._meeting(whole, part, parts)) for part in range(parts)]
        meeting, listed = written_table(self._once(union_all(met))), written_table(whole.drop("shingles"))
        discard(whole, *met)
        links = self._links(docs, listed, meeting)
        # One row per class: the smallest key of a class stands for it.
        by_class = listed.where("n > 0").groupBy("set").agg(F.min("key").alias("least"))
        member = by_class.join(links.select(F.col("node").alias("set"), "component"), "set", "left")
        member = member.withColumn("component", F.coalesce("component", "set"))
        least = member.groupBy("component").agg(F.min("least").alias("top"))
        named = member.join(least, "component").select("set", "top")
        return (
            listed.select("key", "n", "set").join(named, "set", "left")
            .select("key", "n", F.when(F.col("n") > 0, F.coalesce("top", "key")).otherwise(F.col("key")).alias("component"))
        )

    # ---- shingles ------------------------------------------------------------------------------------------

    def _heavy(self, docs: DataFrame) -> np.ndarray:
        """Shingles in more than about ``heavy_share`` of the documents, from rarer to more frequent.

        A task sends on the shingles that exceed the share among its own rows, in blocks of rows; their counts are added up.
        The list orders shingles and decides nothing, so that it may be cut at ``max_heavy``.
        """
        size, share = self.size, self.heavy_share

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            rows = 0

            def flush():
                h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, int))
                often = n >= max(3, share * rows)
                return pa.RecordBatch.from_arrays([pa.array(signed(h[often])), pa.array(n[often])], names=["h", "c"])

            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    h, doc = shingle_hashes(words, size)
                    held.append(distinct_by_doc(h, doc, b - a)[0])
                    rows += b - a
                    if sum(map(len, held)) > 4_000_000:
                        yield flush()
                        held, rows = [], 0
            yield flush()

        top = (
            docs.select("text").mapInArrow(frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
            .orderBy(F.desc("c"), "h").limit(self.max_heavy).toPandas()
        )
        return top["h"].to_numpy(np.int64)[::-1].copy()

    def _listed(self, docs: DataFrame, heavy: np.ndarray) -> DataFrame:
        """(key, n, set, shingles): the class of each row and the shingles it is listed under, for the first of its class in a task."""
        size, num, den = self.size, self.num, self.den
        order = np.argsort(heavy.view(U64))
        shared = docs.sparkSession.sparkContext.broadcast((heavy.view(U64)[order], order))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, place = shared.value
            seen: set[int] = set()
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    h, cuts = distinct_by_doc(*shingle_hashes(words, size), b - a)
                    n = np.diff(cuts)
                    total = np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(0xA24BAED4963EE407)))])
                    name = mix((total[cuts[1:]] - total[cuts[:-1]]) ^ n.astype(U64))
                    rank = np.full(len(h), -1, np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[at] == h, place[at], -1)
                    lists = []
                    for i in range(b - a):
                        here = int(name[i])
                        if n[i] == 0 or here in seen:
                            lists.append(None)
                            continue
                        if len(seen) < 2_000_000:  # forgetting a class only lists it twice
                            seen.add(here)
                        s, r = h[cuts[i] : cuts[i + 1]], rank[cuts[i] : cuts[i + 1]]
                        m = len(s)
                        lead = m - -(-num * m // den) + 1
                        # the hashes are sorted, so a stable sort by rank leaves the light ones in their order
                        pick = np.argsort(r, kind="stable")[:lead] if (r >= 0).any() else slice(0, lead)
                        lists.append(signed(s[pick]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(signed(name)),
                         pa.array(lists, pa.list_(pa.int64()))], names=["key", "n", "set", "shingles"])

        kind = docs.schema["key"].dataType.simpleString()
        return docs.mapInArrow(listed, f"key {kind}, n int, set long, shingles array<long>")

    def _signatures(self, docs: DataFrame, wanted: DataFrame, arrays: bool) -> DataFrame:
        """(set, bits): the bitmap or the sorted array of each class in ``wanted`` (set, key), from the row with that key."""
        size, bits = self.size, self.bits

        def signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    h, cuts = distinct_by_doc(*shingle_hashes(words, size), b - a)
                    n = np.diff(cuts)
                    total = np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(0xA24BAED4963EE407)))])
                    name = mix((total[cuts[1:]] - total[cuts[:-1]]) ^ n.astype(U64))
                    out = []
                    for i in range(b - a):
                        if arrays:
                            out.append(h[cuts[i] : cuts[i + 1]].tobytes())
                            continue
                        out.append(parities(h[cuts[i] : cuts[i + 1]], bits).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(out, pa.binary())], names=["set", "bits"])

        keys = broadcast_if_small(wanted.where("key is not null").select("key"), 1_000_000)
        texts = docs.join(keys, "key", "left_semi").select("text").unionAll(docs.where("key is null").select("text"))
        made = texts.mapInArrow(signed_sets, "set long, bits binary")
        return made.join(broadcast_if_small(wanted.select("set"), 1_000_000), "set", "left_semi").dropDuplicates(["set"])

    # ---- tiles ---------------------------------------------------------------------------------------------

    def _meeting(self, listed: DataFrame, part: int, parts: int) -> DataFrame:
        """(shingle, set, n, place): the listings under the shingles of a part that meet another class of a size within reach."""
        num, den = self.num, self.den
        each = listed.where("shingles is not null").select("set", "n", F.posexplode("shingles").alias("place", "shingle"))
        each = each.where(F.pmod("shingle", F.lit(parts)) == part)

        def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None  # the last row of the batch before, whose neighbour is still to come
            held_meets = False
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                if held is not None:
                    rows = pa.concat_tables([held, rows])
                if rows.num_rows == 0:
                    continue
                k, s = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                fresh = np.ones(len(k), bool)  # a class that several tasks list is one listing
                fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
                rows = rows.filter(pa.array(fresh)).combine_chunks()
                k, n = k[fresh], rows.column(2).to_numpy().astype(np.int64)
                near = (k[1:] == k[:-1]) & (n[:-1] * den >= n[1:] * num)
                keep = np.zeros(len(k), bool)
                keep[:-1] |= near
                keep[1:] |= near
                keep[0] |= held_meets
                held, held_meets = rows.slice(len(k) - 1), bool(keep[-1])
                yield from rows.slice(0, len(k) - 1).filter(pa.array(keep[:-1])).to_batches()
            if held is not None and held_meets:
                yield from held.combine_chunks().to_batches()

        dealt = each.select("shingle", "set", "n", "place").repartition(F.col("shingle")).sortWithinPartitions("shingle", "n", "set")
        return dealt.mapInArrow(meeting, "shingle long, set long, n int, place int")

    @staticmethod
    def _once(meeting: DataFrame) -> DataFrame:
        """``meeting`` with one shingle for all those that the same classes list; the classes' hashes tell these apart.

        The tiles of two such shingles are equal. Two documents that share a long passage would meet under each shingle of it.
        """
        who = meeting.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("set")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "set")).alias("_y"),
            F.min("place").alias("place"),
        )
        one = who.groupBy("_n", "_x", "_y").agg(F.min(F.struct("place", "shingle")).alias("_one"))
        return meeting.join(one.select(F.col("_one.shingle").alias("shingle")), "shingle", "left_semi")

    def _tiles(self, rows: DataFrame) -> DataFrame:
        """Rows (shingle, n, ...) once for each tile they belong to: their band and the next, cut into pairs of blocks."""
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(self.den / self.num)) + F.lit(1e-9)).cast("int")
        rows = rows.withColumn("_band", band)
        # A class is at home in its band; the next band holds the larger partners, whom it visits.
        rows = rows.withColumn("band", F.explode(F.array("_band", F.col("_band") + 1)))
        many = rows.groupBy("shingle", "band").count().where(F.col("count") > self.block)
        cut = many.select("shingle", "band", F.ceil(F.col("count") / self.block).cast("int").alias("_g"))
        rows = rows.join(broadcast_if_small(cut), ["shingle", "band"], "left")
        mine = F.pmod(F.xxhash64("set"), F.col("_g")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
        alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        return rows.withColumn("part", F.explode(F.when(F.col("_g") > 1, pairs).otherwise(alone))).withColumn(
            "home", F.col("_band") == F.col("band")
        )

    def _promising(self, tiles: DataFrame) -> DataFrame:
        """(set) of the classes whose bitmap lets them link with any other of a tile."""
        num, den = self.num, self.den
        keys = ["shingle", "band", "i", "j"]

        def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tiles, starts in whole_runs(batches, keys):
                n, name = tiles.column("n").to_numpy().astype(np.int64), tiles.column("set").to_numpy()
                home = np.asarray(tiles.column("home")).astype(bool)
                maps = utf8(tiles.column("bitmap"))
                first = starts[:-1]
                open_ = (np.diff(starts) > 1) & np.logical_or.reduceat(home, first)
                found = [np.zeros(0, np.int64)]
                for t in np.flatnonzero(open_):
                    r = slice(int(starts[t]), int(starts[t + 1]))
                    found.append(name[r][partnered(n[r], home[r], folded(*maps, r), num, den)])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["set"])

        columns = ["shingle", "band", F.col("part.i").alias("i"), F.col("part.j").alias("j"), "n", "set", "home", "bitmap"]
        dealt = tiles.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "n", "set")
        return dealt.mapInArrow(promising, "set long").distinct()

    def _candidates(self, tiles: DataFrame, quota: int) -> DataFrame:
        """(a, b): from each tile a forest of the pairs whose bitmaps let them link, between different components."""
        num, den = self.num, self.den
        keys = ["shingle", "band", "i", "j"]

        def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tiles, starts in whole_runs(batches, keys):
                n = tiles.column("n").to_numpy().astype(np.int64)
                name, group = tiles.column("set").to_numpy(), tiles.column("component").to_numpy()
                home = np.asarray(tiles.column("home")).astype(bool)
                maps = utf8(tiles.column("bitmap"))
                refuted = tiles.column("refuted")
                first = starts[:-1]
                open_ = (np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)) & np.logical_or.reduceat(home, first)
                left, right = [], []
                for t in np.flatnonzero(open_):
                    r = slice(int(starts[t]), int(starts[t + 1]))
                    a, b = spanning(n[r], name[r], group[r], home[r], folded(*maps, r), refuted[r].to_pylist(), num, den, quota)
                    left += a
                    right += b
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        columns = ["shingle", "band", F.col("part.i").alias("i"), F.col("part.j").alias("j"), "n", "set", "component", "home", "bitmap", "refuted"]
        dealt = tiles.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "n", "set")
        return dealt.mapInArrow(forest, "a long, b long").distinct()

    def _verified(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """(a, b, linked) by intersecting the sorted arrays of both."""
        num, den = self.num, self.den

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch.column(2), batch.column(3)
                yes = []
                for x, y in zip(left, right, strict=True):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    yes.append(both * den >= (len(x) + len(y) - both) * num)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(yes, pa.bool_())], names=["a", "b", "linked"])

        # only the arrays that a pair needs travel
        need = [broadcast_if_small(pairs.select(F.col(c).alias("set")).distinct(), 1_000_000) for c in "ab"]
        one, two = (signatures.join(sets, "set", "left_semi") for sets in need)
        one = one.select(F.col("set").alias("a"), F.col("sorted").alias("x"))
        two = two.select(F.col("set").alias("b"), F.col("sorted").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, linked boolean")

    def _keyed(self, listed: DataFrame, sets: DataFrame) -> DataFrame:
        """(set, key) of ``sets``: the smallest key of each."""
        return listed.join(broadcast_if_small(sets, 1_000_000), "set", "left_semi").groupBy("set").agg(F.min("key").alias("key"))

    def _links(self, docs: DataFrame, listed: DataFrame, meeting: DataFrame) -> DataFrame:
        """(node, component) of the classes that have a link. ``meeting`` and what else is staged here goes with it."""
        wanted = written_table(self._keyed(listed, meeting.select("set").distinct()))
        maps = written_table(self._signatures(docs, wanted, arrays=False))
        bitmaps = maps.withColumnRenamed("bits", "bitmap")
        # Most classes meet others in a shared passage only; bitmaps tell these apart from what may link.
        hopeful = written_table(self._promising(self._tiles(meeting).join(bitmaps, "set")))
        every, meeting = meeting, written_table(meeting.join(broadcast_if_small(hopeful, 1_000_000), "set", "left_semi"))
        discard(every)
        arrays = written_table(self._signatures(docs, self._keyed(wanted, hopeful), arrays=True))
        signatures = arrays.withColumnRenamed("bits", "sorted")
        discard(wanted, hopeful)
        spark = docs.sparkSession
        links = spark.createDataFrame([], "a long, b long")
        refuted = spark.createDataFrame([], "a long, b long")
        named = spark.createDataFrame([], "node long, component long")
        tried: list[DataFrame] = []
        step = 0
        while True:
            rows = meeting if step else meeting.where(F.col("place") < self.first_keys)
            rows = rows.join(named.select(F.col("node").alias("set"), "component"), "set", "left")
            rows = rows.withColumn("component", F.coalesce("component", "set"))
            if step:
                mixed = rows.groupBy("shingle").agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
                rows = rows.join(mixed.where("_x <> _y").select("shingle"), "shingle", "left_semi")
            lost = refuted.groupBy("a").agg(F.collect_set("b").alias("refuted")).withColumnRenamed("a", "set")
            open_ = written_table(rows.select("shingle", "set", "n", "component"))
            rows = self._tiles(open_).join(bitmaps, "set").join(lost, "set", "left")
            pairs = written_table(self._candidates(rows, 32 ** max(step - 1, 0)))
            checked = written_table(self._verified(pairs, signatures))
            discard(open_, pairs)
            tried.append(checked)
            found = checked.agg(F.count(F.lit(1)), F.count_if("linked")).first()
            if found[0] == 0 and step > 1:
                discard(meeting, maps, arrays, *tried)  # ``named`` has files of its own
                return named
            step += 1
            if found[1]:
                links = links.unionAll(checked.where("linked").select("a", "b"))
                named = components(links)
                links = named.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            both = checked.where("not linked")
            refuted = refuted.unionAll(both.select("a", "b")).unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b")))


def parities(h: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of a set: whether an odd number of its hashes have a remainder, for each remainder of a power of two.

    There are as many bits as elements at least: in a shorter one, the maps of large sets differ in too few bits to refute
    any pair. Its halves, xor-ed, are the bitmap of half as many bits.
    """
    bits = max(least, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(data: np.ndarray, offsets: np.ndarray, rows: slice) -> np.ndarray:
    """The bitmaps of some rows as 64-bit numbers, all as long as the shortest."""
    start, width = offsets[rows.start : rows.stop], np.diff(offsets[rows.start : rows.stop + 1])
    least = int(width.min())
    out = np.empty((len(width), least // 8), U64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        maps = data[start[at][:, None] + np.arange(w)].view(U64)
        while maps.shape[1] > least // 8:
            maps = maps[:, : maps.shape[1] // 2] ^ maps[:, maps.shape[1] // 2 :]
        out[at] = maps
    return out


def partnered(n: np.ndarray, home: np.ndarray, bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows of a tile, which come by size, that may link with another one; see ``spanning`` for the bound."""
    marked = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        lo = int(np.searchsorted(n * den, n[i] * num))
        open_ = home[lo:i] | home[i]
        if marked[i]:
            open_ &= ~marked[lo:i]
        at = lo + np.flatnonzero(open_)
        if len(at):
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            may = at[(n[at] + n[i] - differ) * (num + den) >= 2 * num * (n[at] + n[i])]
            if len(may):
                marked[may] = marked[i] = True
    return marked


def spanning(
    n: np.ndarray, name: np.ndarray, group: np.ndarray, home: np.ndarray, bits: np.ndarray, refuted: list, num: int, den: int, quota: int
) -> tuple[list[int], list[int]]:
    """Pairs of a tile that may link and join two trees; rows come by size. A pair needs one row at home in the tile's band.

    With ``quota`` 1 a pair joins its trees at once, as if it linked: near copies are hung together by few pairs. Else each row
    is paired with up to ``quota`` rows of every other tree, and no tree grows: what is left after the first pass is mostly
    pairs whose bits promise more than their arrays hold.

    The overlap of two sets is at most (n1 + n2 - bits in which their maps differ) / 2: each such bit is an element of
    exactly one of them. Linking needs an overlap of num (n1 + n2) / (num + den).
    """
    tree = np.unique(group, return_inverse=True)[1]
    left, right = [], []
    for i in range(1, len(n)):
        lo = int(np.searchsorted(n * den, n[i] * num))
        if lo >= i:
            continue
        open_ = np.flatnonzero(tree[lo:i] != tree[i])
        if not home[i]:
            open_ = open_[home[lo:i][open_]]
        if not len(open_):
            continue
        at = lo + open_
        differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
        may = at[(n[at] + n[i] - differ) * (num + den) >= 2 * num * (n[at] + n[i])]
        if len(may) and refuted[i]:
            may = may[~np.isin(name[may], refuted[i])]
        if quota > 1:
            order = np.argsort(tree[may], kind="stable")
            t = tree[may][order]
            pick = may[order[np.arange(len(t)) - np.searchsorted(t, t) < quota]]
            left += np.maximum(name[pick], name[i]).tolist()
            right += np.minimum(name[pick], name[i]).tolist()
            continue
        while len(may):
            j = may[0]
            left.append(max(int(name[i]), int(name[j])))
            right.append(min(int(name[i]), int(name[j])))
            tree[tree == tree[j]] = tree[i]
            may = may[tree[may] != tree[i]]
    return left, right
