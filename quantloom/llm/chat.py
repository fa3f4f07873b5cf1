"""Chat formatting: snapshots of growing conversations collapse to the longest before rendering.

A log that is written after every turn holds each conversation many times over. The rolling hash of
a conversation's turns up to each turn finds snapshots: a conversation whose whole hash is the hash
of a proper prefix of another goes (an anti-join), and of equal conversations the one with the
smallest id stays. The hash of a prefix is the sum of the hashes of (position, role, text), so that
it is a prefix sum, and no conversation has to meet one task for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged

CHUNK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def half(seed: int) -> Column:
    """A 62-bit hash of a turn as a decimal, whose sums cannot overflow."""
    value = F.xxhash64(F.lit(seed), "position", "role", "text", F.col("role").isNull(), F.col("text").isNull())
    return value.cast("decimal(38,0)")


def before(rows: DataFrame, keys: list[str], sums: dict[str, Column], order: list) -> DataFrame:
    """Adds the sums of all earlier rows of the group, by chunks of ``part``: a window inside each
    (group, part), and offsets from one row for each (group, part)."""
    groups = [*keys, "part"]
    totals = rows.groupBy(*groups).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(g).alias(f"_{g}") for g in groups), *(F.sum(f"_t_{n}").over(ahead).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    zero = F.lit(0).cast("decimal(38,0)")
    same = [held[g].eqNullSafe(offsets[f"_{g}"]) for g in groups]
    return held.join(offsets, same).select(
        *rows.columns, *((F.coalesce(f"_i_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in sums)
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 0), and the hash of the turns up to each."""
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("part", F.floor(F.col("turn") / CHUNK))
    order = ["turn", "role", "text"]
    rows = before(rows, ["conv_id"], {"position": F.lit(1).cast("decimal(38,0)")}, order)
    rows = rows.withColumn("position", F.col("position").cast("long"))
    rows = before(rows, ["conv_id"], {"_a": half(1), "_b": half(2)}, ["position"])
    return rows.select(
        "conv_id", "turn", "role", "text", "position",
        F.xxhash64(F.col("_a") + half(1)).alias("hash_a"), F.xxhash64(F.col("_b") + half(2)).alias("hash_b"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The turns of the conversations that no other conversation repeats and continues.

    Turns go by (turn, role, text), null first; a repeated turn is a turn of its own. Null roles and
    texts are values like others, a null conv_id is a conversation. Of equal conversations the
    smallest id stays, a null id first. Other columns of ``turns`` are left out.
    """
    hashed = staged(prefixes(turns), "chat-turns")
    key = ["position", "hash_a", "hash_b"]
    last = hashed.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select("conv_id", "end.*")
    # Every place where a conversation goes on: one row for each prefix, however many share it.
    ends = last.select("conv_id", F.col("position").alias("_end"))
    inner = hashed.join(ends, hashed["conv_id"].eqNullSafe(ends["conv_id"])).where("position < _end").select(*key).distinct()
    # Equal conversations are one row for each map task before they meet.
    best = last.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("best"))
    kept = best.join(inner, key, "left_anti").select("best.conv_id")
    return hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["conv_id"]), "left_semi")


def rendered(turns: DataFrame, open_: str = OPEN, close: str = CLOSE) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, text.

    A turn is ``<open>role\\ntext<close>``, turns joined by line ends; a null role is "user", a null
    text empty; markers inside texts and roles lose their bar, so that no text can open a turn.
    An empty table gives no rows.
    """
    plain = lambda c, other: F.replace(F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("<")), F.lit("|>"), F.lit(">"))
    body = F.concat(F.lit(open_), plain("role", "user"), F.lit("\n"), plain("text", ""), F.lit(close))
    parts = maximal_conversations(turns).withColumn("_body", body)
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "_body"))).alias("all"))
    return listed.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.concat_ws("\n", F.col("all._body")).alias("text"))
