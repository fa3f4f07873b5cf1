"""Merkle manifest of a table: ternary hash trees a source, one tree over the sources, proofs.

Leaves are narrow rows (id, source, digest); texts are hashed where they are read and never move.
They are ranked within their source by range partitions and their counts. The base-3 digits of a
rank name a leaf's place on each level: inside a block of ``3 ** DIGITS`` leaves the digit columns
are grouped away one after the other, each step nesting the child structs under their node, in the
one exchange that brought the block together. The roots of the blocks are the leaves of the next
tier, so no tree, however large its source, meets one task. Paths go down again by exploding the
nested structs: a leaf meets its siblings without a join; blocks (not leaves) get the path above
them by their key. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged

FAN = 3
#: Levels of a block: it holds FAN ** DIGITS leaves, the bound of every group.
DIGITS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column) -> Column:
    return digest(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key, leaf, seen: ``key`` orders sources bytewise, null first; ``seen`` is the leaf of the
    tampered row where tampering changes it, else null."""
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        leaf_digest(F.col("text")).alias("leaf"),
        F.when(tampered, leaf_digest(cut)).alias("seen"),
        F.monotonically_increasing_id().alias("seq"),  # parts equal rows only
    )


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0) and ``height`` (levels of the tree) within ``key``.

    Ranges of (key, order) give partitions; a window numbers the rows of a key inside one, and
    offsets come from one row for each (key, partition)."""
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = staged(rows.repartitionByRange(F.col("key").asc(), *by).withColumn("part", F.spark_partition_id()), name)
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("key")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy(*by))
    levels = sum(((F.col("total") > FAN**i).cast("int") for i in range(39)), F.lit(0))
    return placed.withColumn("inside", inside).join(counts, ["key", "part"]).select(
        *rows.columns, (F.col("before") + F.col("inside") - 1).alias("rank"), levels.alias("height")
    )


def rolled(rows: DataFrame, base: int) -> DataFrame:
    """key, block, height, node for rows (key, rank, height, hash, more): ``node`` nests the block's
    levels ``base + 1`` to ``base + DIGITS``; levels above a tree's height pass their only node on."""
    more = [c for c in rows.columns if c not in ("key", "rank", "height", "hash")]
    digit = lambda i: (F.floor(F.col("rank") / FAN**i) % FAN).cast("int")
    out = rows.select(
        "key", F.floor(F.col("rank") / FAN**DIGITS).alias("block"), "height",
        *(digit(i).alias(f"d{i}") for i in range(1, DIGITS)),
        F.struct(digit(0).alias("d"), "hash", *more).alias("node"),
    ).repartition("key", "block")
    for i in range(DIGITS):
        above = [f"d{j}" for j in range(i + 1, DIGITS)]
        out = out.groupBy("key", "block", "height", *above).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        own = F.when(F.col("height") > base + i, digest(joined)).otherwise(F.col("kids")[0]["hash"])
        place = F.col(above[0]) if above else F.lit(0)
        out = out.select("key", "block", "height", *above[1:], F.struct(place.alias("d"), own.alias("hash"), "kids").alias("node"))
    return out


def opened(blocks: DataFrame, base: int, keep: Sequence[str] = ()) -> DataFrame:
    """The rows ``rolled`` nested, from (key, block, height, node, path, keep): each gets ``path``, the
    digests left and right of it on every level up to its root, nearest first."""
    out = blocks.withColumn("at", F.col("block"))
    for i in reversed(range(DIGITS)):
        hashes = F.transform("node.kids", lambda k: k["hash"])
        out = out.select("key", "at", "height", "path", *keep, hashes.alias("hashes"), F.posexplode("node.kids").alias("pos", "node"))
        side = lambda start, length: F.array_join(F.slice("hashes", start, length), "")
        step = F.struct(side(F.lit(1), F.col("pos")).alias("left"), side(F.col("pos") + 2, F.lit(FAN)).alias("right"))
        path = F.when(F.col("height") > base + i, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        out = out.select("key", (F.col("at") * FAN + F.col("pos")).alias("at"), "height", path.alias("path"), *keep, "node")
    return out.withColumnRenamed("at", "rank")


def tree(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of rows (key, rank, height, hash, more) from the leaves up, and each key's root: the
    only block of the last tier. A tier's blocks are the next one's rows."""
    top = rows.agg(F.max("height")).first()[0] or 0
    tiers, base = [rolled(rows, 0)], 0
    while True:
        roots = staged(tiers[-1].select("key", F.col("block").alias("rank"), "height", F.col("node.hash").alias("hash")), name)
        base += DIGITS
        if base >= top:
            return tiers, roots
        tiers.append(rolled(roots, base))


def down(tiers: list[DataFrame], above: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Leaves with their whole paths; ``above`` (key, path, keep) continues them beyond the roots."""
    rows = tiers[-1].join(above, "key")
    for i in reversed(range(len(tiers))):
        rows = opened(rows, i * DIGITS, keep)
        if i:
            rows = tiers[i - 1].join(rows.select("key", F.col("rank").alias("block"), "path", *keep), ["key", "block"])
    return rows


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and
    ``proof``, the path that folds the leaf into the root.

    A null field counts as ``-``. Rows without an id come first in their source, rows without a source
    are a source of their own before all others. Rows that repeat an id follow each other by their
    leaves; equal rows have equal leaves and a place each. Empty texts count 0 bytes. An empty table
    gives no rows. Columns other than the five are not read.
    """
    narrow = staged(leaves(docs), "merkle-leaves")
    rows = staged(ranked(narrow, ["doc_id", "leaf", "seq"], "merkle-order").drop("seq").withColumnRenamed("leaf", "hash"), "merkle-ranks")
    tiers, subroots = tree(rows, "merkle-blocks")
    tops = subroots.select(F.lit("all").alias("key"), F.col("key").alias("source"), F.col("hash"))
    tops = staged(ranked(tops, ["source"], "merkle-sources"), "merkle-source-ranks")
    upper, root = tree(tops, "merkle-source-blocks")
    start = root.select("key", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    above = down(upper, start, ["root"]).select(F.col("node.source").alias("key"), "path", "root", F.col("node.hash").alias("subroot"))
    found = down(tiers, staged(above, "merkle-tops"), ["root", "subroot"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    fold = F.aggregate("path", F.coalesce("node.seen", "node.hash"), lambda h, s: digest(F.concat(s["left"], h, s["right"])))
    out = found.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "subroot", "root",
        digest(siblings).alias("proof_sha256"), fold.alias("folded_root"), F.col("path").alias("proof"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
