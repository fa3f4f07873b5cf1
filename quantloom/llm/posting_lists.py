"""Approximate nearest neighbours on balanced posting lists.

Vectors are put into the lists of their nearest centroids; one near a boundary is put into several.
Centroids come from balanced clustering of a bounded sample and are searched through a graph that
every task holds (at most ``MAX_LISTS`` centroids). A query reads the lists whose centroids are not
much farther than the nearest, by the ratio of distances, and ranks their vectors exactly. Its k-th
distance then bounds what any unread list can hold: a list whose centroid is farther than that plus
the list's radius is left out, the others are read too, so that nothing near is missed.

Lists are cut into parts of bounded size, and the queries of a list into blocks, so that neither a
common vector nor a popular list meets one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged

LIST_ROWS, MAX_LISTS, SAMPLE_ROWS = 512, 2048, 16384
#: Replicas: at most so many lists a vector, and no farther than this ratio to the nearest.
REPLICAS, REPLICA_RATIO = 4, 1.03
#: Lists within this ratio of the nearest centroid's distance are read.
READ_RATIO = 1.12
DEGREE, ENTRIES, EXPAND = 24, 4, 8
PART_ROWS, BLOCK_QUERIES = 2048, 4096
NEIGHBOURS = 10


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Balanced k-means: a centroid's distance grows with what it holds beyond an equal share."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    share = len(sample) / len(centres)
    load = np.full(len(centres), share)
    for _ in range(rounds):
        apart = (sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)
        penalty = 0.1 * apart.min(1).mean() * (load / share - 1)
        mine = (apart + penalty).argmin(1)
        held = np.bincount(mine, minlength=len(centres)).astype(float)
        load = 0.5 * load + 0.5 * held
        sums = np.stack([np.bincount(mine, sample[:, d], len(centres)) for d in range(sample.shape[1])], 1)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], sample[rng.choice(len(sample), len(centres))])
    return np.unique(centres, axis=0)


class Graph:
    """Centroids joined to their nearest ones and, in a ring, to the next, so that all are reached."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        n = len(centres)
        apart = ((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1)).astype(float)
        np.fill_diagonal(apart, np.inf)
        near = np.argsort(apart, 1, kind="stable")[:, : min(DEGREE, max(n - 1, 1))]
        self.edges = np.concatenate((near, (np.arange(n)[:, None] + 1) % n), 1)
        self.entries = np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)

    def search(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distances (points x centroids) of the centroids found within ``ratio`` of the nearest one
        found, infinity elsewhere. All points go in step: each expands its nearest open centroids."""
        n, k = len(points), len(self.centres)
        found, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        rows = np.arange(n)
        found[:, self.entries] = distances(points, self.centres[self.entries])
        width = min(EXPAND, k)
        while len(rows):
            limit = found[rows].min(1) * ratio
            open_ = np.where(done[rows], np.inf, found[rows])
            nearest = np.argpartition(open_, width - 1, 1)[:, :width]
            worth = np.take_along_axis(open_, nearest, 1) <= limit[:, None]
            # The first always counts until the walk has come to rest at a nearest centroid.
            going = worth.any(1)
            rows, nearest, worth = rows[going], nearest[going], worth[going]
            if not len(rows):
                break
            at = np.repeat(rows, width)[worth.ravel()]
            node = nearest.ravel()[worth.ravel()]
            done[at, node] = True
            to = self.edges[node]
            who = np.repeat(at, to.shape[1])
            what = to.ravel()
            fresh = np.isinf(found[who, what])
            who, what = who[fresh], what[fresh]
            if len(who):
                pair = np.unique(who * k + what)
                who, what = pair // k, pair % k
                found[who, what] = np.sqrt(((points[who] - self.centres[what]) ** 2).sum(1))
        return np.where(found <= found.min(1)[:, None] * ratio, found, np.inf)

    def lists(self, points: np.ndarray) -> list[list[int]]:
        """The lists of each vector: the nearest, and for one near a boundary the others found within
        ``REPLICA_RATIO`` of it, nearest first."""
        found = self.search(points, REPLICA_RATIO)
        order = np.argsort(found, 1, kind="stable")[:, :REPLICAS]
        near = np.isfinite(np.take_along_axis(found, order, 1))
        return [row[on].tolist() for row, on in zip(order, near, strict=True)]


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.sqrt(((left[:, None] - right[None]) ** 2).sum(-1))


def usable(vector: Column, dims: int | None = None) -> Column:
    """Vectors with finite components, not all zero (and of the given length)."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & (x.cast("double") != nan) & (F.abs(x.cast("double")) < inf))
    some = F.exists(vector, lambda x: x != 0)
    good = vector.isNotNull() & finite & some
    return F.coalesce(good & (F.size(vector) == dims) if dims else good, F.lit(False))


def matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dims)


class Index:
    """The sampled centroids, and all vectors in the lists of theirs."""

    def __init__(self, vectors: DataFrame, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS):
        spark = vectors.sparkSession
        held = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        held = held.where(usable(F.col("v")))
        sizes = held.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        self.dims, self.rows = (sizes.d, sizes["count"]) if sizes else (0, 0)
        self.vectors = held.where(F.size("v") == self.dims)
        if not self.rows:
            return
        sample = self.vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample_rows)
        points = np.array([r.v for r in sample.select("v").collect()], np.float64)  # sample_rows at most
        lists = max(1, min(MAX_LISTS, math.ceil(self.rows / list_rows), len(points)))
        self.graph = spark.sparkContext.broadcast(Graph(centroids_of(points, lists)))
        self.lists = staged(self.assigned(self.vectors), "posting-lists")
        radii = np.full(len(self.graph.value.centres), -np.inf)  # of the vectors at home in a list
        for r in self.lists.where("away IS NOT NULL").groupBy("list").agg(F.max("away").alias("away")).collect():
            radii[r["list"]] = r.away  # MAX_LISTS rows at most
        self.radii = spark.sparkContext.broadcast(radii)

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """(list, vec_id, v, away): ``away``, the distance to the centroid, only in a vector's first list."""
        graph, dims = self.graph, self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    points = matrix(part.column("v"), dims)
                    own = graph.value.lists(points)
                    which = np.repeat(np.arange(part.num_rows), [len(o) for o in own])
                    away = np.sqrt(((points - graph.value.centres[[o[0] for o in own]]) ** 2).sum(1))
                    home = np.append(True, which[1:] != which[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c for o in own for c in o], pa.int32()), part.column("vec_id").take(pa.array(which)), part.column("v").take(pa.array(which)), pa.array(away[which], mask=~home)],
                        names=["list", "vec_id", "v", "away"],
                    )

        return vectors.mapInArrow(assign, "list int, vec_id long, v array<double>, away double")

    def read_lists(self, queries: DataFrame, ratio: float) -> DataFrame:
        """(list, query_id, q) for the lists that each query reads."""
        graph, dims = self.graph, self.dims

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found = graph.value.search(matrix(part.column("v"), dims), ratio)
                    which, lists = np.nonzero(np.isfinite(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists, pa.int32()), part.column("vec_id").take(pa.array(which)), part.column("v").take(pa.array(which))],
                        names=["list", "query_id", "q"],
                    )

        return queries.mapInArrow(select, "list int, query_id long, q array<double>")

    def unread_lists(self, queries: DataFrame, ratio: float) -> DataFrame:
        """(list, query_id, q) for the lists :meth:`read_lists` leaves out that may hold a vector as near
        as ``reach``."""
        graph, radii, dims = self.graph, self.radii, self.dims

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    points, reach = matrix(part.column("v"), dims), part.column("reach").to_numpy(zero_copy_only=False)
                    read = np.isfinite(graph.value.search(points, ratio))
                    apart = np.stack([np.sqrt(((graph.value.centres - p) ** 2).sum(1)) for p in points])
                    slack = 1e-9 * (apart + np.where(np.isfinite(radii.value), radii.value, 0))  # rounding
                    which, lists = np.nonzero(~read & (apart - radii.value - slack <= reach[:, None]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists, pa.int32()), part.column("vec_id").take(pa.array(which)), part.column("v").take(pa.array(which))],
                        names=["list", "query_id", "q"],
                    )

        return queries.mapInArrow(select, "list int, query_id long, q array<double>")

    def search(self, queries: DataFrame, k: int = NEIGHBOURS, ratio: float = READ_RATIO) -> DataFrame:
        """query_id, rank, vec_id, score for each (vec_id, v) of ``queries``."""
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.rows:
            return queries.sparkSession.createDataFrame([], schema)
        first = staged(self.nearest(self.lists, staged(self.read_lists(queries, ratio), "posting-reads"), k), "posting-first")
        reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("reach"))
        asked = queries.select("vec_id", "v").join(reach, F.col("vec_id") == F.col("query_id"), "left")
        asked = asked.select("vec_id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        rest = staged(self.unread_lists(asked, ratio), "posting-rest")
        more = self.nearest(self.lists.where("away IS NOT NULL"), rest, k)  # each vector once
        return self.ranked(first.unionByName(more), k)

    @staticmethod
    def ranked(found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return (
            found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        )

    def nearest(self, lists: DataFrame, read: DataFrame, k: int) -> DataFrame:
        """The ``k`` nearest rows of ``lists`` in what each query of ``read`` reads."""
        dims = self.dims
        cut = (
            lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
            .join(read.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")), "list")
        )  # one row for each list
        cut = F.broadcast(staged(cut, "posting-cuts"))  # MAX_LISTS rows at most
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        kept = lists.join(cut, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("block", upto("blocks")).select("list", "part", "block", "vec_id", "v")
        asked = read.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", upto("parts")).select("list", "part", "block", "query_id", "q")
        keys = ["list", "part", "block"]

        def nearest(left, right):
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                points, ids = matrix(left.column("v"), dims), left.column("vec_id").to_numpy()
                asked_, names = matrix(right.column("q"), dims), right.column("query_id").to_numpy()
                for i, point in enumerate(asked_):
                    apart = np.sqrt(((points - point) ** 2).sum(1))
                    apart[ids == names[i]] = np.inf
                    if len(apart) > k:  # all that tie with the k-th stay for the order by id
                        at = np.flatnonzero(apart <= np.partition(apart, k - 1)[k - 1])
                    else:
                        at = np.arange(len(apart))
                    at = at[np.isfinite(apart[at])]
                    at = at[np.lexsort((ids[at], apart[at]))][:k]
                    out += zip([int(names[i])] * len(at), ids[at].tolist(), apart[at].tolist(), strict=True)
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

        found = kept.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
        return self.ranked(found, k).drop("rank")


def neighbours(vectors: DataFrame, every: int = 100, k: int = NEIGHBOURS, ratio: float = READ_RATIO) -> DataFrame:
    """The ``k`` nearest vectors found for each row whose vec_id is divisible by ``every``: query_id,
    rank, vec_id, score (Euclidean distance in doubles), ties to the smaller vec_id.

    Rows without id, null or zero vectors, and vectors with null or non-finite components or of
    another length than most take no part. Rows that repeat an id count once, as its nearest, and
    never for their own id. Fewer candidates give fewer rows; an empty table gives none.
    """
    index = Index(vectors)
    if not index.rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.search(index.vectors.where(F.col("vec_id") % every == 0), k, ratio)
