"""N-gram Jaccard join by vertical partitioning, and the components of its links.

All shingles get one global order, rarest first. Documents whose similarity reaches the threshold
share a shingle among the first few of each, so only these prefixes are matched. For each candidate
pair the order is cut into fragments, the overlap is counted in each fragment separately, and the
partial counts are summed.

What keeps the work in proportion to the input where groups of copies are large:

* Equal shingle sets are one class, told by a hash of the set; a class is one node.
* A bucket (the classes that share a prefix shingle) of at most ``SMALL`` classes gives all its pairs
  that length and position allow. In a larger one the class with the fewest rarer shingles is the hub
  and is paired with all; then only pairs of classes that are not connected yet are left, and these
  are taken probe by probe until none is left. No pair between unconnected classes is skipped.
* The order comes from a count sketch with a cell for some ``CELL_WORDS`` words, at most 2**24 cells.
  Any order gives the same links; a coarser one only makes more candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import binary, mix, packed, slices, staged, text_bytes, tokens_of, unpacked

WORDS, PERCENT = 5, 80
CELL_WORDS, LEAST_BITS, MOST_BITS, SKETCH_ROWS = 32, 16, 24, 64
FILTER_BITS, FILTER_ROWS = 24, 64
FRAGMENTS = 4
SMALL = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept while a task reads; forgotten when they get many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The set of hashed word n-grams, sorted; a shorter text is one; without words it is empty."""
    own = tokens_of(text)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _STEP + h[i : len(h) - size + 1 + i]
    return np.unique(mix(out))


def set_hash(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes()))))


class Order:
    """The global order of shingles: by sketched count, then by hash."""

    def __init__(self, sketch: np.ndarray):
        self.sketch, self.bits = sketch, len(sketch).bit_length() - 1
        cells = np.bincount(np.minimum(sketch, 1 << 20))
        mass = cells * np.arange(len(cells), dtype=np.float64)
        self.before = np.cumsum(mass) - mass
        self.mass, self.total = mass, max(1.0, mass.sum())

    def counts(self, own: np.ndarray) -> np.ndarray:
        return self.sketch[(own >> np.uint64(64 - self.bits)).astype(np.int64)]

    def sorted(self, own: np.ndarray) -> np.ndarray:
        return own[np.lexsort((own, self.counts(own)))]

    def fragment(self, own: np.ndarray, fragments: int) -> np.ndarray:
        """Which of the equal shares of the order each shingle falls into."""
        c = np.minimum(self.counts(own), 1 << 20)
        inside = (own << np.uint64(self.bits)).astype(np.float64) / 2.0**64
        return np.minimum(((self.before[c] + inside * self.mass[c]) / self.total * fragments).astype(np.int64), fragments - 1)


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    counts, hashes, any_ = np.zeros(1 << bits, np.int32), WordHashes(), False
    for batch in slices(batches):
        own = [shingles(t, hashes, words) for t in binary(batch.column("text"))]
        cell, n = np.unique(np.concatenate(own) >> np.uint64(64 - bits), return_counts=True)
        counts[cell.astype(np.int64)] += n.astype(np.int32)
        any_ = True
    if any_:
        for part, own in enumerate(counts.reshape(SKETCH_ROWS, -1)):
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": [part], "counts": [zlib.compress(packed(own), 1)]})


def _added(group: pa.Table, size: int) -> pa.Table:
    total = sum(unpacked(zlib.decompress(c.as_py()), size) for c in group.column("counts"))
    return pa.table({"part": [group.column("part")[0].as_py()], "counts": [packed(total)]})


def global_order(docs: DataFrame, words: int = WORDS) -> Order:
    """Counts summed part by part; at most 2**24 cells, which is the bound of what is sent out."""
    length = docs.agg(F.sum(text_bytes())).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (length // (6 * CELL_WORDS)).bit_length() - 1))
    size = (1 << bits) // SKETCH_ROWS
    found = docs.select("text").mapInArrow(partial(_sketch, words=words, bits=bits), "part long, counts binary")
    rows = found.groupBy("part").applyInArrow(lambda group: _added(group, size), "part long, counts binary").collect()
    sketch = np.zeros((SKETCH_ROWS, size), np.int32)
    for r in rows:
        sketch[r.part] = np.minimum(unpacked(r.counts, size), np.iinfo(np.int32).max)
    return Order(sketch.ravel())


def _signatures(batches, words: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        own = [shingles(t, hashes, words) for t in binary(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in own], pa.int64())],
            names=["doc_id", "n", "class"],
        )


def _prefixes(batches, order, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    for batch in slices(batches):
        shingle, class_, size, place = [], [], [], []
        for text in binary(batch.column("text")):
            own = shingles(text, hashes, words)
            n = len(own)
            if not n or (key := set_hash(own)) in seen:
                continue
            seen.add(key)
            first = order.value.sorted(own)[: n - -(-percent * n // 100) + 1]
            shingle.append(first.view(np.int64))
            class_.append(np.full(len(first), key, np.int64))
            size.append(np.full(len(first), n, np.int32))
            place.append(np.arange(len(first), dtype=np.int32))
        if shingle:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (shingle, class_, size, place)], names=["shingle", "class", "n", "pos"]
            )


def _fragments(batches, order, wanted, words: int, fragments: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little")
    for batch in slices(batches):
        class_, fragment, sets = [], [], []
        keep = bits[filter_bit(batch.column("doc_id").fill_null(0).to_numpy())] if len(bits) else []
        for text, wanted_ in zip(binary(batch.column("text")), keep, strict=True):
            if not wanted_:
                continue
            own = shingles(text, hashes, words)
            if not len(own):
                continue
            key, of = set_hash(own), order.value.fragment(own, fragments)
            for f in np.unique(of):
                class_.append(key)
                fragment.append(int(f))
                sets.append(own[of == f].view(np.int64))
        if class_:
            yield pa.RecordBatch.from_arrays(
                [pa.array(class_, pa.int64()), pa.array(fragment, pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                names=["class", "fragment", "set"],
            )


def filter_bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids, ``2**FILTER_BITS`` bits whatever the corpus, for scans to skip most
    texts that no candidate needs. It only saves work: the joins after it decide."""
    width = (1 << FILTER_BITS) // FILTER_ROWS

    def cells(batches):
        bits = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            bits[filter_bit(batch.column("rep").to_numpy())] = 1
        for part in np.flatnonzero(bits.reshape(FILTER_ROWS, width).any(1)):
            packed = np.packbits(bits[part * width : (part + 1) * width], bitorder="little")
            yield pa.RecordBatch.from_pydict({"part": [int(part)], "bits": [packed.tobytes()]})

    def joined(group):
        parts = [np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()]
        return pa.table({"part": [group.column("part")[0].as_py()], "bits": [np.bitwise_or.reduce(parts).tobytes()]})

    rows = ids.select("rep").mapInArrow(cells, "part long, bits binary").groupBy("part").applyInArrow(joined, "part long, bits binary")
    held = {r.part: r.bits for r in rows.collect()}
    return b"".join(held.get(p, bytes(width // 8)) for p in range(FILTER_ROWS))


def possible(percent: int):
    """Whether length and position leave room for a link: the shingles from the shared one on."""
    longest = F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return longest & (room * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    return rows.select("shingle", F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), *(F.col(m).alias(f"{m}_{s}") for m in more))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller class first."""
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()


class Join:
    """One run over ``docs``: the order, the classes, the buckets, and links found so far."""

    def __init__(self, docs: DataFrame, words: int, percent: int, fragments: int, small: int):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.words, self.percent, self.fragments, self.small = words, percent, fragments, small
        order = global_order(docs, words)
        self.order = docs.sparkSession.sparkContext.broadcast(order)  # at most 64 MB
        self.signed = staged(self.texts.mapInArrow(partial(_signatures, words=words), "doc_id long, n long, class long"), "jaccard-classes")
        self.reps = staged(self.signed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "jaccard-reps")
        rows = self.texts.where("doc_id IS NOT NULL").mapInArrow(
            partial(_prefixes, order=self.order, words=words, percent=percent), "shingle long, class long, n int, pos int"
        )
        # One exchange: what follows needs the rows of a shingle together, and they stay so.
        rows = rows.repartition("shingle").groupBy("shingle", "class").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
        rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("m > 1")
        self.buckets = staged(rows, "jaccard-buckets")
        self.edges: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold, by partial overlaps summed over the fragments."""
        pairs = staged(pairs, "jaccard-pairs")
        used = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = self.texts.sparkSession.sparkContext.broadcast(id_filter(self.reps.join(used, "class", "left_semi")))
        held = self.texts.where("doc_id IS NOT NULL").mapInArrow(
            partial(_fragments, order=self.order, wanted=wanted, words=self.words, fragments=self.fragments),
            "class long, fragment int, set array<long>",
        )
        # An id may stand for several texts, and a class for several ids that hash alike.
        held = held.join(used, "class", "left_semi").dropDuplicates(["class", "fragment"])
        left = held.select(F.col("class").alias("a"), "fragment", F.col("set").alias("sa"))
        right = held.select(F.col("class").alias("b"), "fragment", F.col("set").alias("sb"))
        counted = (
            pairs.join(left, "a").join(right, ["b", "fragment"])
            .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
            .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
        )
        return counted.where(F.col("both") * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent).select("a", "b")

    def add(self, links: DataFrame) -> None:
        """Adds links, as ids of their classes' representatives."""
        reps = self.reps
        found = (
            links.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("u")), "a")
            .join(reps.select(F.col("class").alias("b"), F.col("rep").alias("v")), "b")
            .select("u", "v")
        )
        self.edges = staged(found if self.edges is None else self.edges.unionByName(found), "jaccard-links")

    def components(self) -> DataFrame:
        """class, comp: the smallest id reachable."""
        labels = components(self.edges)
        return self.reps.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("class", F.coalesce("label", "rep").alias("comp"))

    def run(self) -> DataFrame:
        low, high = self.buckets.where(F.col("m") <= self.small), self.buckets.where(F.col("m") > self.small)
        pairs = side(low, "a").join(side(low, "b"), "shingle").where(F.col("a") < F.col("b")).where(possible(self.percent))
        hub = high.groupBy("shingle").agg(F.min(F.struct("pos", "class", "n")).alias("h"))
        hub = hub.select("shingle", F.col("h.class").alias("a"), F.col("h.n").alias("na"), F.col("h.pos").alias("pa"))
        starred = hub.join(side(high, "b"), "shingle").where("a <> b").where(possible(self.percent))
        names = ["a", "b", "na", "nb"]
        self.add(self.links(ordered(pairs.select(names).unionByName(starred.select(names)))))
        probes, done = self.small, None
        while True:
            comps = staged(self.components(), "jaccard-components")
            rows = high.join(comps, "class")
            home = rows.join(hub.select("shingle", F.col("a").alias("class")), ["shingle", "class"], "left_semi").select("shingle", F.col("comp").alias("home"))
            least = high.groupBy("shingle").agg(F.min("n").alias("least"))
            # Classes apart from the hub whose place still leaves room for some partner of the bucket.
            partner = F.greatest(F.col("least"), F.ceil(F.col("n") * self.percent / 100))
            room = (F.col("n") - F.col("pos")) * (100 + self.percent) >= (F.col("n") + partner) * self.percent
            apart = rows.join(home, "shingle").where("comp <> home").join(least, "shingle").where(room).select(rows.columns)
            if done is not None:
                apart = apart.join(done, ["shingle", "class"], "left_anti")
            nth = F.row_number().over(Window.partitionBy("shingle").orderBy("pos", "class"))
            turn = staged(apart.withColumn("k", nth).where(F.col("k") <= probes).select(rows.columns), "jaccard-probes")
            if not turn.take(1):
                return comps
            met = side(turn, "a", "comp").join(side(rows, "b", "comp"), "shingle").where("comp_a <> comp_b").where(possible(self.percent))
            self.add(self.links(ordered(met.select(names))))
            here = turn.select("shingle", "class")
            done = staged(here if done is None else done.unionByName(here), "jaccard-done")
            probes *= 2


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (u, v): the smallest node it is connected with.

    Large and small stars in turn: every node hangs its larger neighbours on its smallest one, then
    itself and its smaller ones. Rounds grow with the logarithm of the longest path.
    """
    same = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    state = None
    while True:
        both = same.unionByName(same.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        same = both.join(low, "u").where("v > u").select(F.col("low").alias("u"), "v").where("u <> v").distinct()
        down = same.select(F.col("v").alias("x"), F.col("u").alias("y"))  # x > y
        low = down.groupBy("x").agg(F.min("y").alias("low"))
        hung = down.join(low, "x")
        same = hung.select(F.col("low").alias("u"), F.col("y").alias("v")).unionByName(hung.select(F.col("low").alias("u"), F.col("x").alias("v")))
        same = staged(same.where("u <> v").distinct(), "stars")
        now = same.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(same.groupBy("v").agg(F.min("u").alias("label")).withColumnRenamed("v", "node"), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS, small: int = SMALL) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    ``doc_id`` is a whole number. Documents without text or words have no shingles and are their own
    component. A row without an id takes no part and has its copies' component, or none. Rows that
    repeat an id are one node. Columns other than doc_id and text are not read; an empty table gives
    no rows.
    """
    join = Join(docs, words, percent, fragments, small)
    comps = join.run()
    return (
        join.signed.join(comps, "class", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    )


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the document of the smallest id of each component, one of its rows where the id
    repeats; rows without an id stay."""
    kept = jaccard_components(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))
