"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``t`` of the schedule has the golden-ratio point ``frac(t * phi)``, which is mapped through the
cumulative weights to a source; the slots of a source are ranked, and the slot of rank ``r`` takes
block ``r`` of the source: ``block`` consecutive words of its shuffled documents, which begin again
at their end. A source's last slot is cut where its target is reached, and what the points left
short is added by closing slots, so that a source's taken words are its target, rounded down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import running, staged, token_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
#: At least so many slots, and no more words in a block than this.
SLOTS, BLOCK_WORDS = 1 << 17, 8192
#: Golden-ratio step in units of 2**-31, odd, so that the points of a period are all distinct.
STEP = 1327217885
BUCKETS, LANES = 64, 256


def shuffle_key() -> Column:
    """A uniform 64-bit number of id and text (60 bits of their MD5)."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - (1 << 59)) * 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """One row for each source: source, place (by code point, null last), source_size, target.

    ``weights`` repeat over the places; all targets are ``share`` of all sizes; no target is above
    ``epochs`` times its source: those that would be stop there and the rest shares the excess by
    weight (sources in the order of capacity by weight: a prefix of them is full).
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", "place")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(everything) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * epochs)
        .withColumn("_room", F.col("_cap") / F.col("_w"))
        .withColumn("_goal", F.sum("source_size").over(total) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_goal") - F.col("_full")) / F.sum("_w").over(after))
        .withColumn("_stops", F.max((F.col("_level") <= F.col("_room")).cast("int")).over(by_room))
        .withColumn("_first", F.min(F.when(F.col("_stops") == 1, F.struct("_room", "place", "_level"))).over(total)["_level"])
        .withColumn("target", F.when(F.col("_stops") == 0, F.col("_cap").cast("double")).otherwise(F.least(F.col("_first") * F.col("_w"), F.col("_cap").cast("double"))))
        .select("source", "place", "source_size", "target")
    )


def schedule(targets: DataFrame, slots: int, block: int) -> DataFrame:
    """One row for each slot: slot, place (of the source), rank, from_word, to_word (on the source's
    endless line of shuffled documents). Closing slots come after the ``slots`` points."""
    spark = targets.sparkSession
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("place")
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    bounds = targets.where("target >= 1").select(
        "place",
        F.floor("target").alias("words"),
        (F.sum("target").over(upto) / F.sum("target").over(whole)).alias("until"),
        (F.coalesce(F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("target").over(whole)).alias("since"),
        (F.row_number().over(Window.orderBy(F.col("place").desc())) == 1).alias("last"),
    )
    period = 1 << 31
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % period * STEP % period / F.lit(float(period))).alias("point")
    )
    # Cumulative weights are looked up by cell: a source is matched with the cells it covers.
    cells = 4096
    covered = bounds.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("since") * cells), F.least(F.floor(F.col("until") * cells), F.lit(cells - 1))))
    )
    dealt = (
        points.withColumn("cell", F.floor(F.col("point") * cells))
        .join(covered, "cell")
        .where((F.col("point") >= F.col("since")) & ((F.col("point") < F.col("until")) | F.col("last")))
        .select("slot", "place", "words", F.floor(F.col("slot") * LANES / slots).alias("lane"))
    )
    per_lane = dealt.groupBy("place", "lane").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_lane.select("place", "lane", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    inside = Window.partitionBy("place", "lane").orderBy("slot")
    ranked = (
        dealt.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offset, ["place", "lane"])
        .select("slot", "place", "words", (F.col("_in") + F.col("off")).alias("rank"))
    )
    have = per_lane.groupBy("place").agg(F.sum("n").alias("have"))
    need = F.ceil(F.col("words") / F.lit(block))
    closing = (
        bounds.join(have, "place", "left")
        .withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
        .where(need > F.col("have"))
        .select((F.lit(slots) + F.col("place")).alias("slot"), "place", "words", F.explode(F.sequence(F.col("have"), need - 1)).alias("rank"))
    )
    return (
        ranked.unionByName(closing)
        .withColumn("from_word", F.col("rank") * block)
        .where(F.col("from_word") < F.col("words"))
        .select("slot", "place", "rank", "from_word", F.least(F.col("from_word") + block, F.col("words")).alias("to_word"))
    )


def mixture(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place on their source's line, targets, pieces taken slot by slot).

    Documents are shuffled by a hash of id and text, so reruns agree. A null or empty text has size
    0 and is never taken; a null source is a source of its own; repeated rows are documents of
    their own; an empty table gives empty results. Columns named like the results are not read.
    """
    sized = docs.select("doc_id", "source", token_count(F.col("text")).alias("size"), shuffle_key().alias("_hash"))
    sized = staged(sized, "mix-sizes")
    targets = staged(source_targets(sized, weights, share, epochs), "mix-targets")
    words = sized.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(BLOCK_WORDS, int(words * share) // SLOTS))
    placed = running(sized, ["source"], ["_hash", "doc_id"], {"starts": "size", "line": "1"}, BUCKETS)
    same = placed["source"].eqNullSafe(targets["source"])
    line = staged(
        placed.join(targets, same).select("doc_id", "place", "line", "size", "starts", "source_size", "target"), "mix-line"
    )
    slots = schedule(targets, max(1, -(-int(words * share) // block)), block)
    pieces = (
        line.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("begins", F.col("starts") + F.col("epoch") * F.col("source_size"))
        .where(F.col("begins") < F.floor("target"))
        .withColumn("ends", F.col("begins") + F.col("size"))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("begins") / block), F.floor((F.col("ends") - 1) / block))))
    )
    taken = (
        pieces.join(slots, ["place", "rank"])
        .withColumn("words", F.least("ends", "to_word") - F.greatest("begins", "from_word"))
        .where("words > 0")
        .select("slot", "place", "line", "doc_id", "epoch", (F.greatest("begins", "from_word") - F.col("begins")).alias("first_word"), "words")
    )
    return line, targets, taken


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (repeats counted)."""
    line, _, taken = mixture(docs, weights, share, epochs)
    per_doc = taken.groupBy("place", "line").agg(F.sum("words").alias("taken"))
    return line.join(per_doc, ["place", "line"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """``docs`` as the mix takes them: a document is there as often as its words are taken, the
    part of a copy at the end of a source's words counting from one half."""
    line, targets, taken = mixture(docs, weights, share, epochs)
    copies = (
        line.join(taken.groupBy("place", "line").agg(F.sum("words").alias("taken")), ["place", "line"])
        .where("size > 0")
        .select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    )
    # Repeated rows share an id: their copies are summed and dealt to one of the rows' equals.
    copies = copies.groupBy("doc_id").agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.withColumn("_size", token_count(F.col("text"))).where("_size > 0").drop("_size")
    whole = rows.select(F.struct(*(rows[c] for c in docs.columns)).alias("_row"), rows["doc_id"].alias("_id"))
    return (
        whole.join(copies, whole["_id"].eqNullSafe(copies["doc_id"]))
        .withColumn("_n", F.round(F.col("_copies") / F.col("_rows")).cast("int"))
        .where("_n > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select("_row.*")
    )
