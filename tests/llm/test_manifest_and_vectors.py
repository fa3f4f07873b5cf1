"""Merkle manifest, lattice near-duplicates and hard negatives against plain loops."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bond_negatives, lattice_dedup, merkle_manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars) -> str:
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(part(v) for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a ternary tree and, for each leaf, what stands left and right of it level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, node in enumerate(at):
            run = node - node % 3
            paths[leaf].append(("".join(nodes[run:node]), "".join(nodes[node + 1 : run + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], paths


def manifest_rows(docs: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for row in docs:
        groups[row[3]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        rows = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((rows, *climb([leaf_of(*r) for r in rows])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (rows, subroot, paths), top in zip(trees, tops, strict=True):
        for row, path in zip(rows, paths, strict=True):
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                seen = (row[0], row[1].replace("\n", ""), *row[2:])
            folded = leaf_of(*seen)
            for left, right in path + top:
                folded = h(left, folded, right)
            proof = h(*(left + right for left, right in path + top))
            out.append((row[0], leaf_of(*row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def test_manifest_equals_a_plain_tree(spark):
    docs = [(i, f"text {i}\nline" if i % 3 else f"text {i}", "en" if i % 4 else None, "hot" if i % 2 else f"s{i % 31}", i) for i in range(900)]
    docs += [(None, "no id\n", "en", "hot", 5), (2, None, None, None, None), (3, "", "de", "", 0), (7, "text 7\nline", "en", "hot", 7), (7, "text 7\nline", "en", "hot", 7)]
    docs += [(7, "an id again\n", "en", "hot", 7), (11, "é" * 20000 + "\n", "fr", "é", 20001), (12, "alone", "fr", "Z", 5), (-5, "a\nb", "x", "hot", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.repartition(7, "n_chars").withColumns({c: F.lit("clash") for c in ("key", "rank", "height", "node", "hash", "part")})
    got = merkle_manifest.manifest(frame)
    rows = [tuple(r) for r in got.drop("proof").collect()]
    assert sorted(rows, key=str) == manifest_rows(docs)
    assert 0 < sum(r[-1] for r in rows) < len(rows)
    one = got.where("doc_id = 12").select("leaf", "root", "proof").first()
    folded = one.leaf
    for step in one.proof:
        folded = h(step.left, folded, step.right)
    assert folded == one.root
    assert merkle_manifest.manifest(frame.limit(0)).count() == 0


def test_manifest_of_one_document(spark):
    frame = spark.createDataFrame([(4, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle_manifest.manifest(frame).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("") and row.verified


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=2, size=(400, 8))
    own = lattice_dedup.decode(x)
    doubled = np.rint(own * 2)
    assert (doubled == own * 2).all() and (own.sum(1) % 2 == 0).all()
    assert ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all()
    assert len(lattice_dedup.neighbours()) == 240
    apart = ((x - own) ** 2).sum(1)
    for step in lattice_dedup.neighbours():  # the facets of a cell belong to these neighbours
        assert (((x - own - step) ** 2).sum(1) >= apart - 1e-9).all()


def near_rows(rng, groups: list[int], dims: int = 16, noise: float = 0.02) -> list[list[float]]:
    out = []
    for size in groups:
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        out += [(base + rng.normal(scale=noise, size=dims)).tolist() for _ in range(size)]
    return out


def linked_rows(rows: list[tuple], cosine: float) -> dict[int, tuple[int, int]]:
    """n_links and the smallest reachable id of each id, by all pairs."""
    fine = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, near = defaultdict(int), defaultdict(set)
    for a in fine:
        for b in fine:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a[0]] += 1
                    near[a[0]].add(b[0])
    out = {}
    for i in (r[0] for r in rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        out[i] = (links[i], min(seen))
    return out


@pytest.mark.parametrize("part_rows", [1024, 16])
def test_near_vectors_equal_all_pairs(spark, part_rows):
    rng = np.random.default_rng(8)
    vectors = near_rows(rng, [60, 25, 9, 4, 2, *[1] * 60]) + near_rows(rng, [20], 16, 0.05)
    rows = [(1000 - i, v, i % 2 if i % 29 else None) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(40)] + [(3000, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(3001, None, 1), (3002, [], 1), (3003, [0.0] * 16, 1), (3004, [float("nan")] * 16, 1), (3005, [float("inf")] + [1.0] * 15, 0)]
    rows += [(3006, [None] + [1.0] * 15, 0), (3007, rows[3][1][:8], rows[3][2]), (3008, rows[3][1][:8], rows[3][2]), (3009, [1e300] * 16, 0), (3010, [1e-300] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("class", "cell", "size")})
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(frame, part_rows=part_rows).collect()}
    want = linked_rows(rows, 0.98)
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] for i in want)  # none below the cosine, none twice
    assert sum(got[i].n_links for i in want) >= 0.999 * sum(n for n, _ in want.values())
    assert [i for i in want if got[i].component_id != want[i][1]] == []
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[3009].n_links == 1 and got[3004].n_links == 0
    assert lattice_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_that_repeat_an_id(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(lattice_dedup.near_duplicates(frame).collect(), key=str)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == sorted(
        [(5, 3, 5, True), (5, 3, 5, True), (5, 0, 5, True), (6, 3, 5, False), (None, 3, 5, False), (None, 0, None, True)], key=lambda r: f"Row(vec_id={r[0]}, n_links={r[1]}"
    )


def test_recall_on_pairs_at_the_threshold():
    """Pairs of cosine 0.98 exactly, the hardest to find, meet in some cell."""
    rng = np.random.default_rng(4)
    x, z = (rng.normal(size=(3000, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1)[:, None]
    labels = np.zeros(3000, np.int64)
    (own_x, probe_x), (own_y, probe_y) = lattice_dedup.cells(x, labels), lattice_dedup.cells(y, labels)
    met = (own_x == own_y) | (probe_x == own_y[..., None]).any(-1) | (probe_y == own_x[..., None]).any(-1)
    assert met.any(1).mean() > 0.998
    apart = (own_x[:-1] == own_y[1:]).mean()
    assert apart < 1e-3  # cells are fine


def negatives_by_loops(rows: list[tuple], every: int, dims: int) -> list[tuple]:
    held = {}
    for i, v, label in sorted((r for r in rows if None not in r and len(r[1]) == dims and None not in r[1]), key=lambda r: (r[0], r[2], r[1])):
        if all(math.isfinite(x) for x in v):
            held.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a in (i for i in held if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(held[a][1], v, strict=True)), i) for i, (_, v) in held.items())
        for ps, p in [(-s, i) for s, i in scored if i != a and held[i][0] == held[a][0]][:5]:
            fits = [(i, -s) for s, i in scored if held[i][0] != held[a][0] and 30 * ps <= 100 * -s <= 90 * ps]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(fits[:10])]
    return sorted(out)


@pytest.mark.parametrize("shelf_rows,batch_anchors", [(8192, 512), (64, 8)])
def test_hard_negatives_equal_loops(spark, shelf_rows, batch_anchors):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) + (i % 3)).tolist(), int(rng.integers(0, 10)) if i % 3 else 4) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 6) for i in range(15)] + [(1100 + i, [-x for x in rows[0][1]], i % 10) for i in range(8)]
    rows += [(2000, [0.0] * 12, 1), (2010, None, 1), (2020, rows[1][1], None), (2030, [float("nan")] * 12, 1), (2040, [None] + [1.0] * 11, 1), (2050, [1.0] * 5, 1)]
    rows += [(20, rows[3][1], 9), (20, rows[20][1], rows[20][2]), (None, rows[5][1], 2), (3000, [200.0] * 12, 3), (3001, [150.0] * 12, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("shelf", "batch", "row", "rank")})
    got = bond_negatives.hard_negatives(frame, every=20, shelf_rows=shelf_rows, batch_anchors=batch_anchors)
    assert got.dtypes == [(n, "int" if n == "rank" else "bigint") for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_loops(rows, 20, 12)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(10**4 + i), float(-(3**i)), 1.5 * i, 90000.25], i % 2) for i in range(10)]
    rows += [(50, [1e30, 0.0, 0.0, 0.0], 1), (51, [600000.0] * 4, 0)]  # beyond the limit
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = bond_negatives.hard_negatives(frame, every=1)
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_loops(rows[:-2], 1, 4)
    assert bond_negatives.hard_negatives(frame.limit(0)).count() == 0
    assert bond_negatives.hard_negatives(frame.where("vec_id = 0"), every=1).count() == 0


def test_scans_leave_most_columns_unread():
    """On clustered rows the bitmaps are empty before the last columns are read."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 64))
    values = np.floor(256 * (np.repeat(centres, 500, 0) + rng.normal(scale=0.1, size=(5000, 64)))).astype(np.int64)
    read = 0

    class Counted(bond_negatives.Reading):
        def steps(self, at):
            nonlocal read
            inner, keep = super().steps(at), None
            while True:
                try:
                    seen = inner.send(keep)
                except StopIteration:
                    return
                read += len(seen[0]) * bond_negatives.STEP
                keep = yield seen

    plain, bond_negatives.Reading = bond_negatives.Reading, Counted
    try:
        for label in range(10):
            columns = np.ascontiguousarray(values[label * 500 : label * 500 + 500].T)
            part = bond_negatives.Slice(label, np.arange(500), columns.astype(float), columns.min(1), columns.max(1))
            anchor = values[0].astype(float)
            tops = [(bond_negatives.Top(10, low), high) for low, high in [bond_negatives.window(int(anchor @ anchor), 30, 90)]]
            bond_negatives.scan_negatives(anchor, part, tops)
    finally:
        bond_negatives.Reading = plain
    assert read < 0.3 * values.size
