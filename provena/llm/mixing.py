"""Mixing sources to target weights: blocks of packed tokens, drawn by shard and joined by index. DataFrame functions only.

1. The words of a source's documents, in a pseudorandom order of documents, form one stream, cut into blocks of ``block``
   words. A document's place in the stream is the sum of the sizes before it: by bucket first, then inside its bucket.
2. A source's target says how many words it gives: whole passes over its stream and a last, partial one. Each pass maps
   its slots 0, 1, 2, .. through a pseudorandom permutation of the block indexes; the last slot is cut to the exact rest.
3. Slots of all sources are dealt to output shards through one more permutation. What a shard gets of each source is then
   a multinomial draw under the condition that the sources' totals meet their targets (slots are exchangeable). A free
   draw would miss a small source's target by its own sampling error.
4. Blocks meet slots by (source, index), an equality join on a key that no source makes hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.ranking import broadcast_if_small
from provena.functions.text import bind
from provena.session import written_table

# Fixed value: a word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code point order, null last, repeating. cap: a target is at most so many times its source.

    block: words in a block. shard_slots: slots in an output shard. bucket_rows: about so many documents are numbered by
    one task. seed: of every pseudorandom choice. A source is one of a configured list, so one row per source is small.
    """

    weights: Sequence[float] = (5, 2, 1)
    cap: float = 3.0
    block: int = 256
    shard_slots: int = 4096
    bucket_rows: int = 2_000
    seed: int = 11

    def sized(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """(doc_id, source, size) of every row: a null text has size 0, a null source is a source of its own.

        Written once, so that texts are read once and every later step sees the same rows.
        """
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        return written_table(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size")))

    def targets(self, sized: DataFrame) -> DataFrame:
        """(source, sid, source_size, target): shares of all sizes by weight, capped at ``cap`` times the source's own size.

        The level that capped sources leave to the others is found without a loop: sources are sorted by cap over weight,
        and the capped ones are those before the first whose cap is above its share of what is left.
        """
        per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
        per = per.withColumn("sid", F.row_number().over(order) - 1)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in self.weights]), (F.col("sid") % len(self.weights) + 1).cast("int"))
        per = per.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(self.cap)))
        by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "sid")
        before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy()
        left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
        weights = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
        per = per.withColumn("level", left / weights)
        # The level rises as long as sources are capped and falls after that: the first that is not capped has the highest.
        free = F.max(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.col("level"))).over(whole)
        target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("limit", F.coalesce(free * F.col("w"), "limit")))
        return per.select("source", "sid", "source_size", target.alias("target"))

    def blocks(self, sized: DataFrame, targets: DataFrame) -> DataFrame:
        """(doc_id, sid, size, at): each row's place in its source's stream. Rows without words come along at place null."""
        rows = sized.count()
        buckets = max(1, -(-rows // self.bucket_rows))
        mine = F.xxhash64(F.lit(self.seed), "doc_id", "size")
        joined = sized.join(
            broadcast_if_small(targets.select(F.col("source").alias("_s"), "sid")), F.col("source").eqNullSafe(F.col("_s"))
        ).drop("_s")
        dealt = joined.withColumn("_h", mine).withColumn("_b", F.pmod("_h", F.lit(buckets)))
        in_bucket = Window.partitionBy("sid", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        totals = dealt.groupBy("sid", "_b").agg(F.sum("size").alias("_n"))
        earlier = Window.partitionBy("sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("sid", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
        return (
            dealt.withColumn("_in", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
            .join(starts, ["sid", "_b"])
            .select("doc_id", "sid", "size", F.when(F.col("size") > 0, F.col("_from") + F.col("_in")).alias("at"))
        )

    def slots(self, targets: DataFrame) -> DataFrame:
        """(sid, pass, slot, block, words, shard, position) of every slot of the mix, in no order; ``block`` indexes the source's stream."""
        n = F.ceil(F.col("source_size") / F.lit(self.block))
        plan = (
            targets.where("source_size > 0 and target > 0")
            .withColumn("want", F.round("target").cast("long"))
            .withColumn("n", n)
            .withColumn("short", F.col("n") * self.block - F.col("source_size"))
            .withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast((want - 1) div source_size as int)"))))
            .withColumn("rest", F.least(F.col("source_size"), F.col("want") - F.col("pass") * F.col("source_size")))
            .where("rest > 0")
        )
        # The stream's last block is short. If its slot falls among the slots of a pass, they hold that much less.
        spot = plan.withColumn("gap", inverse(F.col("n") - 1, F.col("n"), F.col("sid"), F.col("pass"), self.seed))
        need = F.ceil(F.col("rest") / self.block)
        spot = spot.withColumn("slots", F.when(F.col("gap") < need, F.ceil((F.col("rest") + F.col("short")) / self.block)).otherwise(need))
        first = Window.orderBy("sid", "pass").rowsBetween(Window.unboundedPreceding, -1)  # a few rows per source
        spot = spot.withColumn("base", F.coalesce(F.sum("slots").over(first), F.lit(0)).cast("long"))
        spot = spot.withColumn("all", F.sum("slots").over(Window.partitionBy()).cast("long"))
        # Ranges of slots first, so that a large source is spread before its slots are listed.
        step = self.shard_slots
        ranges = spot.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots").cast("long") - 1, F.lit(step).cast("long"))))
        tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows now, many once listed
        ranges = ranges.repartition(tasks, F.xxhash64("sid", "pass", "lo"))
        each = ranges.withColumn("slot", F.explode(F.sequence("lo", F.least(F.col("lo") + step, F.col("slots").cast("long")) - 1)))
        each = each.withColumn("block", permuted(F.col("slot"), F.col("n"), F.col("sid"), F.col("pass"), self.seed))
        full = F.least(F.lit(self.block).cast("long"), F.col("source_size") - F.col("block") * self.block)
        done = F.col("slot") * self.block - F.when(F.col("gap") < F.col("slot"), F.col("short")).otherwise(F.lit(0))
        words = F.greatest(F.lit(0).cast("long"), F.least(full, F.col("rest") - done))
        place = permuted(F.col("base") + F.col("slot"), F.col("all"), F.lit(-1), F.lit(-1), self.seed)
        return (
            each.withColumn("words", words).where("words > 0").withColumn("_place", place)
            .select("sid", "pass", "slot", "block", "words", F.expr(f"_place div {step}").alias("shard"), (F.col("_place") % step).alias("position"))
        )

    def taken(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of every row; a row without words gives none.

        Rows with the same key, source and size are interchangeable. An empty table gives no rows.
        """
        sized = self.sized(docs, key, text, source)
        targets = written_table(self.targets(sized))
        placed = written_table(self.blocks(sized, targets).withColumn("row", F.monotonically_increasing_id()))
        # A slot takes the first ``words`` words of its block; equal slots of a block are counted.
        drawn = self.slots(targets).groupBy("sid", "block", "words").agg(F.count(F.lit(1)).alias("times"))
        covers = placed.where("at is not null").withColumn("block", F.explode(F.expr(f"sequence(at div {self.block}, (at + size - 1) div {self.block})")))
        lo = F.greatest(F.col("at") - F.col("block") * self.block, F.lit(0).cast("long"))
        hi = F.least(F.col("at") + F.col("size") - F.col("block") * self.block, F.col("words"))
        # The planner takes the slots for as few as the rows they are listed from: never broadcast them.
        given = covers.join(drawn.hint("merge"), ["sid", "block"]).groupBy("row").agg(
            F.sum(F.greatest(hi - lo, F.lit(0).cast("long")) * F.col("times")).alias("taken")
        )
        info = broadcast_if_small(targets)
        return (
            placed.join(given, "row", "left").join(info, "sid")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )


ROUNDS = 24


def permuted(i: Column, n: Column, *salt: Column | int) -> Column:
    """Place of ``i`` in a pseudorandom permutation of 0 .. n - 1.

    Each round pairs every index with its mirror image about a pseudorandom point and swaps the pair or not, as a hash of
    the pair says. A round is its own inverse, for any n, without tables or large products.
    """
    return _rounds(i, n, F.sequence(F.lit(0), F.lit(ROUNDS - 1)), salt)


def inverse(i: Column, n: Column, *salt: Column | int) -> Column:
    """The index that ``permuted`` takes to ``i``: the same rounds from the last to the first."""
    return _rounds(i, n, F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), salt)


def _rounds(i: Column, n: Column, rounds: Column, salt: Sequence[Column | int]) -> Column:
    keys = [F.lit(s) if isinstance(s, int) else s for s in salt]
    n = n.cast("long")

    def swap(x: Column, k: Column) -> Column:
        return bind(
            F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), k, *keys), n) - x, n),
            lambda y: F.when(F.pmod(F.xxhash64(k, F.greatest(x, y), *keys), F.lit(2)) == 1, y).otherwise(x),
        )

    return F.aggregate(rounds, i.cast("long"), swap)
