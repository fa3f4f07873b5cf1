"""Hard negatives by vertical scans (branch and bound over decomposed vectors).

Candidates are dealt to shelves; a shelf holds its rows label by label, one column a dimension. An
anchor reads a label's columns in the order of its own descending magnitudes. What the dimensions not
read yet can add at least and at most, from each column's smallest and largest value, bounds every
candidate's score; a bitmap of the candidates still open shrinks until the scores are exact. The
positives' scan drops what cannot reach the best found so far, the negatives' scan what cannot fall
into a window below a positive, or not above the window's best so far.

Shelves and batches of anchors are of bounded size and meet as packed groups; a task returns at most
the wanted rows for each anchor (and positive), and the last ranking takes them from all shelves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged

SHELF_ROWS, BATCH_ANCHORS = 8192, 512
#: Dimensions read between two looks at the bitmap.
STEP = 8
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
SHELF = "shelf int, label long, ids binary, columns binary"


@dataclass
class Slice:
    """The rows of one label on a shelf: ids and dims x rows of whole numbers, with each column's range."""

    label: int
    ids: np.ndarray
    columns: np.ndarray
    lows: np.ndarray
    highs: np.ndarray


def column_of(values: np.ndarray, dims: int) -> np.ndarray:
    """Whole numbers as doubles where all sums of products stay exact in them, else as 64-bit integers."""
    most = float(np.abs(values).max(initial=0))
    return values.astype(np.float64 if dims * most * most < 2**52 else np.int64)


class Reading:
    """An anchor's order of dimensions and, before each step, the least and most the rest can add."""

    def __init__(self, anchor: np.ndarray, held: Slice):
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        self.anchor, self.held = anchor[self.order], held
        one, other = self.anchor * held.lows[self.order], self.anchor * held.highs[self.order]
        ahead = lambda x: np.concatenate((np.cumsum(x[::-1])[::-1], [0]))
        self.least, self.most = ahead(np.minimum(one, other)), ahead(np.maximum(one, other))

    def steps(self, at: np.ndarray):
        """Yields (partial scores, least rest, most rest) and receives the bitmap of rows to go on with;
        ends with all dimensions read. ``at``: the rows to begin with, narrowed in place of the bitmap."""
        columns, dims = self.held.columns, len(self.order)
        part = np.zeros(len(at), columns.dtype)
        for start in range(0, dims, STEP):
            which = self.order[start : start + STEP]
            block = columns[which] if len(at) == columns.shape[1] else columns[which[:, None], at]
            part = part + self.anchor[start : start + STEP] @ block
            end = min(start + STEP, dims)
            keep = yield at, part, self.least[end], self.most[end]
            if not keep.all():
                at, part = at[keep], part[keep]
            if not len(at):
                break


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, highest first, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Top:
    """The best rows found so far of one ranking; ``floor`` is what a row must reach to matter."""

    def __init__(self, k: int, low: float = -math.inf):
        self.k, self.low, self.floor = k, low, low
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores.astype(np.int64))), np.concatenate((self.ids, ids))
        at = best(scores, ids, self.k)
        self.scores, self.ids = scores[at], ids[at]
        if len(at) == self.k:
            self.floor = max(self.low, self.scores[-1])

    def sure(self, scores: np.ndarray) -> None:
        """Rows that certainly count reach these scores at least."""
        if len(scores) >= self.k:
            self.floor = max(self.floor, np.partition(scores, len(scores) - self.k)[len(scores) - self.k])


def scan_positives(anchor: np.ndarray, own: int, held: Slice, top: Top) -> None:
    at = np.flatnonzero(held.ids != own)
    reading = Reading(anchor, held)
    if not len(at) or reading.most[0] < top.floor:
        return
    steps, keep = reading.steps(at), None
    at = part = np.zeros(0, np.int64)
    while True:
        try:
            at, part, least, most = steps.send(keep)
        except StopIteration:
            break
        top.sure(part + least)
        keep = part + most >= top.floor
        at, part = at[keep], part[keep]
    top.add(part, held.ids[at])


def scan_negatives(anchor: np.ndarray, held: Slice, tops: list[tuple[Top, int]]) -> None:
    """``tops``: for each positive the ranking (its floor starts at the window's low end) and the high end."""
    reading = Reading(anchor, held)
    tops = [(t, high) for t, high in tops if t.floor <= high and reading.most[0] >= t.floor and reading.least[0] <= high]
    if not tops or not len(held.ids):
        return
    steps, keep = reading.steps(np.arange(len(held.ids))), None
    at = part = np.zeros(0, np.int64)
    while True:
        try:
            at, part, least, most = steps.send(keep)
        except StopIteration:
            break
        keep = np.zeros(len(at), bool)
        for top, high in tops:
            low, up = part + least, part + most
            top.sure(low[(low >= top.low) & (up <= high)])
            keep |= (up >= top.floor) & (low <= high)
        at, part = at[keep], part[keep]
    for top, high in tops:
        inside = (part >= top.floor) & (part <= high)
        top.add(part[inside], held.ids[at[inside]])


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def slices_of(table: pa.Table, dims: int) -> list[Slice]:
    out = []
    for label, ids, columns in zip(*(table.column(c).to_pylist() for c in ("label", "ids", "columns")), strict=True):
        values = np.frombuffer(columns, np.int32).reshape(dims, -1)
        out.append(Slice(label, np.frombuffer(ids, np.int64), column_of(values, dims), values.min(1).astype(np.int64), values.max(1).astype(np.int64)))
    return out


def arrow(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


LONGS = lambda *names: [(n, pa.int64()) for n in names]


def positives_of(shelf: pa.Table, anchors: pa.Table, dims: int, k: int) -> pa.Table:
    held, out = slices_of(shelf, dims), []
    for own, label, values in zip(*(anchors.column(c).to_pylist() for c in ("anchor_id", "label", "c")), strict=True):
        anchor, top = np.frombuffer(values, np.int32).astype(np.int64), Top(k)
        for part in held:
            if part.label == label:
                scan_positives(column_of_like(anchor, part), own, part, top)
        out += [(own, i, s) for i, s in zip(top.ids.tolist(), top.scores.tolist(), strict=True)]
    return arrow(LONGS("anchor_id", "positive_id", "positive_score"), out)


def negatives_of(shelf: pa.Table, anchors: pa.Table, dims: int, k: int, low: int, high: int) -> pa.Table:
    held, out = slices_of(shelf, dims), []
    names = ("anchor_id", "label", "c", "positives")
    for own, label, values, positives in zip(*(anchors.column(c).to_pylist() for c in names), strict=True):
        anchor, tops, each = np.frombuffer(values, np.int32).astype(np.int64), {}, []
        for p in positives:  # positives of one score share a window
            bounds = window(p["positive_score"], low, high)
            each.append((p, tops.setdefault(bounds, Top(k, bounds[0]))))
        for part in held:
            if part.label != label:
                scan_negatives(column_of_like(anchor, part), part, [(t, bounds[1]) for bounds, t in tops.items()])
        for p, top in each:
            out += [(own, p["positive_id"], p["positive_score"], i, s) for i, s in zip(top.ids.tolist(), top.scores.tolist(), strict=True)]
    return arrow(LONGS("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), out)


def column_of_like(anchor: np.ndarray, held: Slice) -> np.ndarray:
    """The anchor in doubles if all its sums with the slice stay exact in them, else the slice in integers."""
    if held.columns.dtype == np.float64:
        most = np.abs(anchor).max(initial=0) * max(np.abs(held.lows).max(initial=0), np.abs(held.highs).max(initial=0))
        if len(anchor) * float(most) < 2**52:
            return anchor.astype(np.float64)
        held.columns = held.columns.astype(np.int64)
    return anchor


def packed(group: pa.Table) -> pa.Table:
    """A shelf's rows as one packed row for each label."""
    shelf, labels = group.column("shelf")[0].as_py(), group.column("label").to_numpy()
    ids = group.column("vec_id").to_numpy()
    values = np.frombuffer(b"".join(group.column("c").to_pylist()), np.int32).reshape(len(ids), -1)
    rows = []
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        rows.append((shelf, int(label), ids[at].tobytes(), np.ascontiguousarray(values[at].T).tobytes()))
    return arrow([("shelf", pa.int32()), ("label", pa.int64()), ("ids", pa.binary()), ("columns", pa.binary())], rows)


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components x become floor(256 x), packed."""
    for batch in batches:
        flat = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
        whole = np.floor(flat * 256).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "label", "c"])


def finite(vector: Column, limit: float) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < limit)), F.lit(False))


def first_ranked(rows: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, shelf_rows: int = SHELF_ROWS, batch_anchors: int = BATCH_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, the rows
    whose vec_id is divisible by ``every``.

    Scores are inner products of floor(256 x), exact; ties go to the smaller vec_id. Rows without id,
    label or vector, with a null or non-finite component, with another length than most (the smaller
    one, if two are equally common; none without components), or with components of 2^27 / 256 and
    more or whose products could leave 64 bits, take no part. Rows that repeat an id count once, as the
    one with the smallest label, then vector. An anchor without positives, and a positive without
    rows in its window (any of negative score has none), give no rows; nor does an empty table.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    held = held.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").where(finite(F.col("v"), math.inf))
    sizes = held.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, count = sizes.d, sizes["count"]
    limit = min(2**27, math.isqrt(2**62 // dims)) / 256
    held = held.where((F.size("v") == dims) & finite(F.col("v"), limit)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("row.label") + 1) % 10).otherwise(F.col("row.label"))
    whole = held.select("vec_id", moved.alias("label"), F.col("row.v").alias("v")).mapInArrow(scaled, "vec_id long, label long, c binary")

    shelves = math.ceil(count / shelf_rows)
    dealt = whole.withColumn("shelf", F.pmod(F.xxhash64("vec_id"), F.lit(shelves)).cast("int"))
    stock = staged(dealt.groupBy("shelf").applyInArrow(packed, SHELF), "bond-shelves")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, ids, columns in zip(*(batch.column(c).to_pylist() for c in ("label", "ids", "columns")), strict=True):
                own = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(own % every == 0)
                values = np.frombuffer(columns, np.int32).reshape(dims, -1).T[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array([label] * len(at), pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["anchor_id", "label", "c"],
                )

    anchors = staged(stock.mapInArrow(pick, "anchor_id long, label long, c binary"), "bond-anchors")
    batches = max(1, math.ceil(anchors.count() / batch_anchors))
    batch = F.pmod(F.xxhash64(F.lit("batch"), "anchor_id"), F.lit(batches)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stock.withColumn("batch", upto(batches)).groupBy("shelf", "batch")

    def met(asked: DataFrame, scan, out: str) -> DataFrame:
        right = asked.withColumn("batch", batch).withColumn("shelf", upto(shelves)).groupBy("shelf", "batch")
        return left.cogroup(right).applyInArrow(scan, out)

    near = met(anchors, lambda a, b: positives_of(a, b, dims, positives), "anchor_id long, positive_id long, positive_score long")
    near = staged(first_ranked(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "bond-positives")
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    far = met(
        anchors.join(windows, "anchor_id"), lambda a, b: negatives_of(a, b, dims, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = first_ranked(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
