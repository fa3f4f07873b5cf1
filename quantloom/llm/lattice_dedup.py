"""Near-duplicate vectors by lattice hashing.

A unit vector is projected at random to ``BLOCKS`` times eight dimensions in each of ``TABLES``
tables, and every eight are decoded to the nearest point of the E8 lattice; the points name the
vector's cell. It also probes the neighbouring cells it lies closest to. Vectors that meet in a cell,
one stored there and one stored or probing, are verified by cosine.

What keeps groups bounded: equal vectors are one class; only cells where two classes meet get any
vectors; the stored rows of a cell are dealt to parts and its visitors to blocks of bounded size. A
task returns counts and a spanning forest of the links it found, never the links themselves. A pair
that meets in several cells is counted in the first, which each task tells from the cells both carry.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import mix, slices, staged
from quantloom.llm.jaccard_join import components
from quantloom.llm.posting_lists import usable

COSINE = 0.98
TABLES, BLOCKS, PROBES = 6, 2, 4
#: Lattice units (minimal distance sqrt 2) for a projection of variance one: the cells' fineness.
SCALE = 0.6
PART_ROWS = 1024
SEED = 12


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest points of E8: two entries of one, or all of a half with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for signs in itertools.product((1, -1), repeat=2):
            point = np.zeros(8)
            point[[i, j]] = signs
            out.append(point)
    out += [np.array(p) for p in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in p) % 2 == 0]
    return np.array(out)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum of each row of ``x``."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    rest = x[odd] - point[odd]
    worst = np.abs(rest).argmax(1)
    point[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (even whole points and the same moved by a half) to each row of ``x``."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=8)
def projection(dims: int, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).normal(scale=SCALE, size=(dims, tables * BLOCKS * 8))


def cell_keys(points: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """64-bit names of cells: ``points`` (rows x BLOCKS * 8) are halves of whole numbers."""
    key = salts.astype(np.uint64)
    for column in np.rint(points.T * 2).astype(np.int64):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    return key.astype(np.int64)


def cells(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (rows x tables) and probed cells (rows x tables x probes) of unit vectors."""
    n, dims = unit.shape
    placed = (unit @ projection(dims, tables)).reshape(n * tables * BLOCKS, 8)
    own = decode(placed)
    # Moving by a neighbour g changes the squared distance by 2 - 2 rest.g: the likeliest other cells.
    worth = ((placed - own) @ neighbours().T).reshape(n * tables, BLOCKS * 240)
    best = np.argpartition(-worth, probes, 1)[:, :probes]
    own = own.reshape(n * tables, BLOCKS * 8)
    salts = mix(np.repeat(labels.astype(np.int64), tables).astype(np.uint64) * np.uint64(tables) + np.tile(np.arange(tables, dtype=np.uint64), n))
    probed = np.empty((n * tables, probes), np.int64)
    for p in range(probes):
        moved = own.copy().reshape(-1, BLOCKS, 8)
        block, which = best[:, p] // 240, best[:, p] % 240
        moved[np.arange(len(moved)), block] += neighbours()[which]
        probed[:, p] = cell_keys(moved.reshape(-1, BLOCKS * 8), salts)
    return cell_keys(own, salts).reshape(n, tables), probed.reshape(n, tables, probes)


def unit_rows(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _located(batches: Iterator[pa.RecordBatch], tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        vectors = batch.column("v").to_pylist()
        lengths = np.array([len(v) for v in vectors])
        labels = batch.column("label").to_numpy()
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            unit = unit_rows([vectors[i] for i in at])
            own, probed = cells(unit, labels[at], tables, probes)
            flat = [pa.array(list(x.reshape(len(at), -1)), pa.list_(pa.int64())) for x in (own, probed)]
            taken = [batch.column(c).take(pa.array(at)) for c in ("class", "label", "size")]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array([int(dims)] * len(at), pa.int32()), pa.array([u.tobytes() for u in unit], pa.binary()), *flat],
                names=["class", "label", "size", "dims", "unit", "own", "probed"],
            )


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for a boolean matrix of links between two lists of ids."""
    top = np.iinfo(np.int64).max
    a, b = np.where(linked.any(1), left, top), np.where(linked.any(0), right, top)
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(0, initial=top))
        a2 = np.minimum(a, np.where(linked, b2[None], top).min(1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    nodes, roots = np.concatenate((left, right)), np.concatenate((a, b))
    some = (roots != top) & (roots != nodes)
    return nodes[some], roots[some]


def compared(left: pa.Table, right: pa.Table, table: int, cell: int, probes: int, cosine: float) -> pa.Table:
    """Counts and a spanning forest of the links between stored rows of a cell and its visitors.

    Output rows: (u, v, links); ``v`` null carries a count of links of ``u``, else (u, v) is an edge.
    """
    column = lambda t, c: t.column(c).to_numpy()
    wide = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten()).reshape(t.num_rows, -1)
    dims = left.column("dims")[0].as_py()
    units = lambda t: np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, dims)
    ids_a, ids_b = column(left, "class"), column(right, "class")
    linked = units(left) @ units(right).T >= cosine
    linked &= (ids_a[:, None] != ids_b) & (column(left, "label")[:, None] == column(right, "label"))
    own_a, own_b = wide(left, "own"), wide(right, "own")
    probe_a, probe_b = (wide(t, "probed").reshape(t.num_rows, -1, probes) for t in (left, right))
    nodes, roots = forest(linked, ids_a, ids_b)
    # A pair of rows stored here shows twice; one with a visitor shows in both cells if both visit.
    stored = own_b[:, table] == cell
    counted = linked & ((ids_a[:, None] < ids_b) | ~stored)
    i, j = np.nonzero(counted)
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        x, y = own_a[i, t], own_b[j, t]
        there = (probe_a[i, t] == y[:, None]).any(1)
        if t < table:
            first &= ~((x == y) | there | (probe_b[j, t] == x[:, None]).any(1))
        else:
            first &= ~(there & (y != cell) & (y < cell))
    i, j = i[first], j[first]
    links_a = np.bincount(i, column(right, "size")[j], len(ids_a)).astype(np.int64)
    links_b = np.bincount(j, column(left, "size")[i], len(ids_b)).astype(np.int64)
    some_a, some_b = links_a > 0, links_b > 0
    u = np.concatenate((ids_a[some_a], ids_b[some_b], nodes))
    links = np.concatenate((links_a[some_a], links_b[some_b], np.zeros(len(nodes), np.int64)))
    empty = pa.nulls(len(u) - len(nodes), pa.int64())
    return pa.table([pa.array(u, pa.int64()), pa.concat_arrays([empty, pa.array(roots, pa.int64())]), pa.array(links)], names=["u", "v", "links"])


def met(located: DataFrame, cosine: float, part_rows: int, probes: int) -> DataFrame:
    """(u, v, links) of all cells where two classes meet."""
    narrow = located.select("class", F.posexplode(F.transform("own", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("stored")))).alias("t", "at"))
    visits = located.select("class", F.posexplode("probed").alias("p", "cell"))
    visits = visits.select("class", F.floor(F.col("p") / probes).cast("int").alias("t"), "cell", F.lit(False).alias("stored"))
    narrow = narrow.select("class", "t", "at.cell", "at.stored").unionByName(visits)
    there = narrow.groupBy("t", "cell").agg(F.count_if("stored").alias("kept"), F.count(F.lit(1)).alias("all"))
    cut = lambda c: F.ceil(F.col(c) / part_rows).cast("int")
    there = there.where("kept > 0 AND all > 1").select("t", "cell", cut("kept").alias("parts"), cut("all").alias("blocks"))
    used = staged(narrow.join(there, ["t", "cell"]), "lattice-meetings").join(located, "class")
    deal = lambda c: F.pmod(F.xxhash64("class"), c).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = used.where("stored").withColumn("part", deal("parts")).withColumn("block", upto("blocks"))
    right = used.withColumn("block", deal("blocks")).withColumn("part", upto("parts"))
    keys = ["t", "cell", "dims", "part", "block"]
    columns = [*keys, "class", "label", "size", "unit", "own", "probed"]

    def compare(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["u", "v", "links"])
        return compared(a, b, key[0].as_py(), key[1].as_py(), probes, cosine)

    grouped = left.select(columns).groupBy(*keys).cogroup(right.select(columns).toDF(*columns).groupBy(*keys))
    return staged(grouped.applyInArrow(compare, "u long, v long, links long"), "lattice-links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each vector: vec_id, n_links (rows linked directly), component_id, kept.

    Linked are vectors of one label (not null) whose cosine reaches ``cosine`` and that meet in a
    cell; all found links are verified. Null and zero vectors, those with null or non-finite
    components and those without a label have no links and are their own component, as are vectors
    of different lengths to each other. Rows that repeat an id are vectors of their own and share its
    component where they link. A row without an id links and counts like any other; alone, its
    component is null and it is kept. An empty table gives no rows.
    """
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & usable(F.col("v"))
    held = held.withColumns({"h": F.when(good, F.xxhash64("label", "v")), "g": F.when(good, F.xxhash64(F.lit(SEED), "v", "label"))})
    equal = held.where(good).groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = staged(equal.withColumn("class", F.monotonically_increasing_id()), "lattice-classes")
    schema = "class long, label long, size long, dims int, unit binary, own array<long>, probed array<long>"
    located = staged(classes.select("class", "label", "size", "v").mapInArrow(lambda b: _located(b, tables, probes), schema), "lattice-points")
    found = met(located, cosine, part_rows, probes)
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"))
    nodes = components(found.where("v IS NOT NULL").select("u", "v"))
    named = classes.select("h", "g", "size", "least", "class")
    whole = nodes.join(named, F.col("node") == F.col("class")).groupBy("label").agg(F.min("least").alias("component"))
    of_class = (
        named.join(counts, F.col("class") == F.col("u"), "left")
        .join(nodes.join(whole, "label"), F.col("class") == F.col("node"), "left")
        .select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    )
    out = held.select("vec_id", "h", "g").join(of_class, ["h", "g"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
