"""Chat formatting: cumulative snapshots collapse to their longest conversation, which is then rendered. DataFrame functions only.

Logs often hold a conversation once per turn: each entry repeats the turns so far. Every turn gets the rolling hash of the
turns up to it. A conversation whose last hash is an inner hash of a longer one is a prefix of it, and an anti-join drops
it; of equal conversations the one with the smallest id stays. Only hashes are compared and shuffled; the text of
the conversations that stay is read once more for rendering.

Hashes: each turn is hashed with its position, two 64-bit values, and a prefix is the exclusive or of its turns. As
a running exclusive or can be taken block by block, a conversation of any length is split among tasks by blocks of turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import written_table


@dataclass(frozen=True)
class ChatTemplate:
    """How a turn is written; ``block`` is the number of consecutive turn numbers that one task numbers and renders; it changes no result."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_turn: str = "<|im_end|>\n"
    block: int = 256

    def collapse(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
        """(conv_id, n_turns, n_copies) of the maximal conversations; ``n_copies`` equal ones, itself included, became one.

        Turns stand in the order of their number, then role and text; rows that repeat a turn entirely count once. Null roles
        and texts are values of their own. Rows without a conversation id or a turn number belong to no conversation.
        """
        hashed = self._hashed(turns, conv, turn, role, text)
        # One row per conversation prefix; equal prefixes of many conversations are combined before they are shuffled.
        full = (
            hashed.groupBy("conv").agg(F.max(F.struct("n", "h", "g")).alias("l"))
            .select("conv", "l.n", "l.h", "l.g")
            .groupBy("n", "h", "g").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
        )
        longer = hashed.where("not final").select("n", "h", "g").distinct()
        return full.join(longer, ["n", "h", "g"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")

    def render(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
        """(conv_id, part, n_turns, n_copies, chat) of every maximal conversation; null roles and texts render as nothing.

        A conversation is one row, whatever its turn numbers: blocks of turns are rendered by many tasks and then joined in order.
        ``part`` is 0 always.
        """
        kept = written_table(self.collapse(turns, conv, turn, role, text))
        rows = self._rows(turns, conv, turn, role, text).join(kept, F.col("conv") == F.col("conv_id"))
        written = F.concat(
            F.lit(self.before_role), F.coalesce("role", F.lit("")), F.lit(self.after_role), F.coalesce("text", F.lit("")),
            F.lit(self.after_turn),
        )
        each = F.struct("turn", F.col("role").isNotNull(), "role", F.col("text").isNotNull(), "text", written.alias("w"))
        blocks = rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(
            F.array_join(F.transform(F.sort_array(F.collect_set(each)), lambda x: x["w"]), "").alias("w")
        )
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "w"))), lambda x: x["w"]), "")
        out = blocks.groupBy("conv_id", "n_turns", "n_copies").agg(whole.alias("chat"))
        return out.select("conv_id", F.lit(0).cast("long").alias("part"), "n_turns", "n_copies", "chat")

    def _rows(self, turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
        part = F.floor(F.col(turn) / F.lit(self.block)).cast("long")
        return turns.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(
            F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), part.alias("part")
        )

    def _hashed(self, turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
        """(conv, n, h, g, final) of every turn: the hash of the first n turns, and whether that is all of them."""
        # The text is replaced by its digest at once: no text is sorted or shuffled here.
        content = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
        rows = self._rows(turns, conv, turn, role, text).select(
            "conv", "part", "turn", F.col("role").isNotNull().alias("has_role"), "role", F.col("text").isNotNull().alias("has_text"),
            content.alias("text"),
        ).distinct()
        inside = Window.partitionBy("conv", "part").orderBy("turn", "has_role", "role", "has_text", "text")
        blocks = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size"))
        before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("conv")
        blocks = blocks.select(
            F.col("conv").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"),
            F.sum("size").over(whole).alias("total"),
        )
        placed = rows.withColumn("i", F.row_number().over(inside)).join(
            blocks, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p"))
        )
        n = F.col("i") + F.col("skip")
        value = [n, F.col("has_role"), F.coalesce("role", F.lit("")), F.col("has_text"), F.col("text")]

        def hash_with(salt: str) -> Column:
            return F.xxhash64(F.lit(salt), *value)

        placed = placed.select("conv", "part", n.alias("n"), "total", hash_with("h").alias("h"), hash_with("g").alias("g"))
        inside = Window.partitionBy("conv", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        block = placed.groupBy("conv", "part").agg(F.bit_xor("h").alias("bh"), F.bit_xor("g").alias("bg"))
        block = block.select(
            F.col("conv").alias("_c"), F.col("part").alias("_p"),
            F.coalesce(F.bit_xor("bh").over(before), F.lit(0)).alias("ph"), F.coalesce(F.bit_xor("bg").over(before), F.lit(0)).alias("pg"),
        )
        rolled = placed.select(
            "conv", "part", "n", "total", F.bit_xor("h").over(inside).alias("h"), F.bit_xor("g").over(inside).alias("g")
        ).join(block, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")))
        return written_table(rolled.select(
            "conv", "n", F.col("h").bitwiseXOR(F.col("ph")).alias("h"), F.col("g").bitwiseXOR(F.col("pg")).alias("g"),
            (F.col("n") == F.col("total")).alias("final"),
        ))
