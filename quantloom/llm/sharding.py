"""K-d tree partitioning: shards of nearly equal bytes by weighted medians along metadata.

A node is split along its widest dimension at the weighted (bytes) median, recursively, until the
leaves hold the target bytes. Medians are found by distributed histograms: all open nodes of a
level narrow their bracket together, one aggregate of at most ``BINS`` rows a node for each round;
rows that tie in the dimension are cut by a hash of the text, then by one of the id, so that equal
texts part only where a cut falls into a group of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import running, staged, text_bytes

DIMENSIONS = ("length", "origin", "language")
BINS = 256
#: A bracket is narrow enough when it holds this part of its node's bytes.
TOLERANCE = 1e-5
HASH_BITS = 48
BUCKETS = 64


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row a document: size, digests and the dimensions as integers.

    ``length`` is the size in 64ths of a power of two; texts of metadata (source, language) are
    spread by their first bytes, null first. A null text has no bytes and the digest of none.
    """
    text = F.coalesce("text", F.lit(""))
    size = text_bytes() + 1
    ordered = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(
        1 + F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(c), "utf-8")), 1, 14), 14, "0"), 16, 10).cast("long")
    )
    mask = F.lit((1 << HASH_BITS) - 1)
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.floor(F.log2(size.cast("double")) * 64).cast("long").alias("length"),
        ordered("source").alias("origin"),
        ordered("lang").alias("language"),
        F.xxhash64(text).bitwiseAND(mask).alias("by_text"),
        F.xxhash64(F.lit("id"), "doc_id", "lang", "source").bitwiseAND(mask).alias("by_id"),
        F.xxhash64("doc_id", text).alias("_hash"),
    )


def side(cuts: dict[int, dict]) -> Column:
    """0 or 1 for each row: before or after the cut of its node (rows of closed nodes: 0)."""
    out = F.lit(0)
    for node, cut in cuts.items():
        after = F.lit(False)
        for name, at in reversed(cut["keys"]):  # compared as (dimension, by_text, by_id)
            after = (F.col(name) > at) | ((F.col(name) == at) & after) if name != cut["keys"][-1][0] else F.col(name) >= at
        out = F.when(F.col("node") == node, after.cast("int")).otherwise(out)
    return out


def medians(rows: DataFrame, nodes: dict[int, dict]) -> dict[int, dict]:
    """The cut of each node: the weighted median of (dimension, by_text, by_id), as exact as
    ``TOLERANCE`` of its bytes asks for."""
    full = (1 << HASH_BITS) - 1
    for n in nodes.values():
        n |= {"keys": [], "key": n["dim"], "low": n["least"], "high": n["most"], "goal": n["bytes"] * n["share"], "done": False}
    while any(not n["done"] for n in nodes.values()):
        parts = []
        for node, n in nodes.items():
            if n["done"]:
                continue
            n["width"] = max(1, -(-(n["high"] - n["low"] + 1) // BINS))
            mine = F.col("node") == node
            for name, at in n["keys"]:
                mine = mine & (F.col(name) == at)
            mine = mine & F.col(n["key"]).between(n["low"], n["high"])
            parts.append(F.when(mine, F.floor((F.col(n["key"]) - n["low"]) / n["width"])))
        binned = rows.withColumn("_bin", F.coalesce(*parts)).where("_bin IS NOT NULL")
        table: dict[int, list] = {}
        for r in binned.groupBy("node", "_bin").agg(F.sum("size").alias("b")).collect():  # BINS rows a node at most
            table.setdefault(r.node, []).append((r["_bin"], r.b))
        for node, n in nodes.items():
            if n["done"]:
                continue
            before, last = 0, None
            for bin_, held in sorted(table[node]):
                last = (bin_, held)
                if before + held >= n["goal"]:
                    break
                before += held
            bin_, held = last
            n["goal"] -= before
            low = n["low"] + bin_ * n["width"]
            high = min(n["high"], low + n["width"] - 1)
            if held <= TOLERANCE * n["bytes"] or (n["key"] == "by_id" and low == high):
                # The bracket goes to the nearer side as a whole.
                edge = low if n["goal"] < held / 2 else high + 1
                n["keys"].append((n["key"], edge))
                n["done"] = True
            elif low == high:
                n["keys"].append((n["key"], low))
                n |= {"key": "by_text" if n["key"] == n["dim"] else "by_id", "low": 0, "high": full}
            else:
                n |= {"low": low, "high": high}
    return nodes


def tree(rows: DataFrame, shards: int) -> tuple[DataFrame, list[dict]]:
    """``rows`` with ``node`` = shard 0 .. shards - 1, and the splits that were made."""
    leaves, splits = {0: (0, shards)}, []
    rows = rows.withColumn("node", F.lit(0))
    while any(n > 1 for _, n in leaves.values()):
        split = [k for k, (_, n) in leaves.items() if n > 1]
        spread = [f(d).alias(f"{a}_{d}") for d in DIMENSIONS for a, f in (("least", F.min), ("most", F.max))]
        stats = {r.node: r for r in rows.where(F.col("node").isin(split)).groupBy("node").agg(F.sum("size").alias("bytes"), *spread).collect()}  # one row a node
        whole = {d: 1 + max((r[f"most_{d}"] for r in stats.values()), default=0) - min((r[f"least_{d}"] for r in stats.values()), default=0) for d in DIMENSIONS}
        if not splits:
            extent = whole
        nodes = {}
        for k in split:
            if k not in stats:
                continue
            r = stats[k]
            dim = max(DIMENSIONS, key=lambda d: (r[f"most_{d}"] - r[f"least_{d}"]) / extent[d])
            n = leaves[k][1]
            nodes[k] = {"dim": dim, "least": r[f"least_{dim}"], "most": r[f"most_{dim}"], "bytes": r.bytes, "share": (n // 2) / n}
        if nodes:
            medians(rows, nodes)
            splits.append({k: {"dim": n["dim"], "keys": n["keys"]} for k, n in nodes.items()})
        after = side(nodes)
        # A node that takes the shards first .. first + n - 1 is named by its first shard.
        step = reduce(lambda e, k: F.when(F.col("node") == k, F.lit(leaves[k][1] // 2)).otherwise(e), nodes, F.lit(0))
        rows = rows.withColumn("node", (F.col("node") + after * step).cast("int"))
        new = {}
        for k, (first, n) in leaves.items():
            if n == 1:
                new[k] = (first, 1)
            else:
                new[first], new[first + n // 2] = (first, n // 2), (first + n // 2, n - n // 2)
        leaves = new
    return rows, splits


def sharded(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot.

    With ``target_bytes`` the number of leaves follows from all bytes. Null and empty texts have
    size 1; repeated rows are placed one by one (rows equal in every column go together); an empty
    table gives none; other columns are not read.
    """
    rows = staged(metadata(docs), "kd-rows")
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed, _ = tree(rows, shards)
    slots = running(placed, ["node"], ["_hash", "doc_id"], {"slot": "1"}, BUCKETS)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
