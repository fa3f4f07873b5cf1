"""Benchmark decontamination with suffix arrays over the training documents.

Documents are cut into shards of a bounded number of words inside the tasks that read them; each
shard gets a suffix array (prefix doubling), and every benchmark suffix is binary-searched in it.
No text is shuffled. The benchmark is the stated query set: it is sent out in blocks of at most
``block_bytes`` of text, one pass over the documents for each block.

Only words of the benchmark get a number; any other word is 0 and ends a match. Stretches of
numbered words shorter than the shortest window cannot hold one and get no suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import binary, words_of

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20


class Benchmark:
    """Numbered words of one block of items, their windows and their suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.words: list[list[int]] = []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())]
            if words:
                self.ids.append(item)
                self.words.append(words)
        of: dict[tuple[int, ...], int] = {}
        self.items_of: list[set[str]] = []
        for item, words in zip(self.ids, self.words, strict=True):
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                k = of.setdefault(tuple(words[i : i + size]), len(of))
                if k == len(self.items_of):
                    self.items_of.append(set())
                self.items_of[k].add(item)
        self.length = np.array([len(w) for w in of], np.int64)
        self.windows = padded(list(of), window)
        self.shortest = int(self.length.min()) if of else 0
        self.depth = max(map(len, self.words), default=0)


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def suffix_array(words: np.ndarray, shortest: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The words with hopeless stretches zeroed, and the positions of the rest in the order of
    their suffixes, which is exact to ``depth`` words (prefix doubling)."""
    n = len(words)
    edge = np.diff(np.concatenate(([0], (words > 0).astype(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - start >= max(1, shortest)
    mark = np.zeros(n + 1, np.int64)
    mark[start[long]] += 1
    mark[stop[long]] -= 1
    keep = np.cumsum(mark[:n]) > 0
    words = np.where(keep, words, 0)
    at = np.flatnonzero(keep)
    if not len(at):
        return words, at
    rank, order, h = words.copy(), at, 1
    while True:
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], 0)
        key = rank[at] * (int(rank.max()) + 1) + after
        by = np.argsort(key, kind="stable")
        order, key = at[by], key[by]
        new = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))))
        rank = np.zeros(n, np.int64)
        rank[order] = new
        h *= 2
        if h >= depth or new[-1] == len(at):
            return words, order


def order_of(words: np.ndarray, at: np.ndarray, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: how the suffixes at ``at`` stand to ``rows`` in their first ``length`` words."""
    span = np.arange(rows.shape[1])
    place = at[:, None] + span
    have = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], 0)
    differ = np.where(span < length[:, None], have - rows, 0)
    first = (differ != 0).argmax(1)
    return np.sign(differ[np.arange(len(at)), first])


def search(words, order, rows, length, beyond: bool) -> np.ndarray:
    """For each row: how many suffixes are smaller (``beyond``: or start with it)."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        sign = order_of(words, order[np.minimum(mid, len(order) - 1)], rows, length)
        right = open_ & ((sign <= 0) if beyond else (sign < 0))
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def shards(texts: list[bytes | None], number: dict[bytes, int], size: int):
    """(first row, words with a 0 after each document, starts, words of each document)."""
    first, parts, counts, held = 0, [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        get = number.get
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        counts.append(len(words))
        held += len(words) + 1
        if held >= size or i == len(texts) - 1:
            joined = np.zeros(held, np.int64)
            starts = np.cumsum([0, *(c + 1 for c in counts[:-1])])
            for s, p in zip(starts, parts, strict=True):
                joined[s : s + len(p)] = p
            yield first, joined, starts, np.array(counts, np.int64)
            first, parts, counts, held = i + 1, [], [], 0


def hits(bench: Benchmark, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard where a window occurs, in order, and the window of each."""
    words, order = suffix_array(words, bench.shortest, bench.windows.shape[1])
    if not len(order):
        return order, order
    low = search(words, order, bench.windows, bench.length, False)
    found = search(words, order, bench.windows, bench.length, True) - low
    which = np.repeat(np.arange(len(low)), found)
    place = order[np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
    by = np.argsort(place, kind="stable")
    return place[by], which[by]


def spans_of(place: np.ndarray, length: np.ndarray) -> list[int]:
    """The union of ``[place, place + length)`` as start, end, start, end, ..."""
    reach = np.maximum.accumulate(place + length)
    fresh = np.concatenate(([True], place[1:] > reach[:-1]))
    ends = reach[np.concatenate((fresh[1:], [True]))]
    return np.stack((place[fresh], ends), 1).ravel().tolist()


def merged(spans: list[int]) -> list[int]:
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return spans_of(pairs[:, 0], pairs[:, 1] - pairs[:, 0])


def _mark(batches: Iterator[pa.RecordBatch], block, window: int, size: int) -> Iterator[pa.RecordBatch]:
    bench = Benchmark(block.value, window)
    for batch in batches:
        texts = binary(batch.column("text"))
        total = np.zeros(len(texts), np.int64)
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        for first, words, starts, counts in shards(texts, bench.number, size):
            total[first : first + len(counts)] = counts
            place, which = hits(bench, words) if bench.shortest else (words[:0], words[:0])
            doc = np.searchsorted(starts, place, "right") - 1
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(doc)], strict=False):  # none of either without hits
                row = first + int(doc[a])
                own = spans_of(place[a:b] - starts[doc[a]], bench.length[which[a:b]])
                spans[row] = merged([*spans[row], *own]) if spans[row] else own
                found = set().union(*(bench.items_of[k] for k in np.unique(which[a:b])))
                items[row] = sorted(found.union(items[row]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("text"), pa.array(total), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            names=["row", "text", "n_words", "spans", "items"],
        )


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size; items without id, text or words have no windows."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), "text"
    )
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row.text) * 4 > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item, row.text))
        held += len(row.text) * 4
    if block:
        yield block


def marked(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``row`` (all columns of ``docs`` as they are), ``n_words``, ``spans`` (start, end, ... of the
    words inside benchmark windows) and ``items`` (ids of the items whose windows occur, sorted).

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. A null or
    empty text has no words and no hit; an item without words has no windows; repeated rows are
    kept, each with its own result; columns of ``docs`` named like the results don't clash, as they
    stay inside ``row``. Empty tables give empty results or no hits.
    """
    spark = docs.sparkSession
    frame = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.col("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in frame.schema.fields])
    blocks = 0
    for block in benchmark_blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(block)
        frame = frame.mapInArrow(partial(_mark, block=held, window=window, size=shard_words), schema)
        blocks += 1
    if not blocks:  # words are counted all the same
        held = spark.sparkContext.broadcast([])
        frame = frame.mapInArrow(partial(_mark, block=held, window=window, size=shard_words), schema)
    return frame.drop("text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    return marked(docs, benchmark, window).where(F.size("spans") == 0).select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: words, hit words, items and their digest."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    return marked(docs.select("doc_id", "text"), benchmark, window).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _longest(batches, block, size: int) -> Iterator[pa.RecordBatch]:
    bench = Benchmark(block.value, 1)
    suffixes = [(k, i) for k, w in enumerate(bench.words) for i in range(len(w))]
    rows = padded([bench.words[k][i:] for k, i in suffixes], max(1, bench.depth))
    length = np.array([len(bench.words[k]) - i for k, i in suffixes], np.int64)
    span = np.arange(rows.shape[1])
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, words, starts, _ in shards(binary(batch.column("text")), bench.number, size):
            words, order = suffix_array(words, 1, bench.depth)
            if not len(order) or not len(rows):
                continue
            spot = search(words, order, rows, length, False)
            best, where = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for near in (spot - 1, spot):
                at = order[np.clip(near, 0, len(order) - 1)]
                place = at[:, None] + span
                have = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], 0)
                same = np.cumprod((have == rows) & (rows > 0), 1).sum(1)
                where, best = np.where(same > best, at, where), np.maximum(best, same)
            doc = np.searchsorted(starts, where, "right") - 1
            got = np.flatnonzero(best)
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": [bench.ids[suffixes[g][0]] for g in got],
                    "item_start": [suffixes[g][1] for g in got],
                    "n_words": best[got],
                    "doc_id": pa.array([ids[first + doc[g]] for g in got], batch.column("doc_id").type),
                    "doc_start": (where - starts[doc])[got],
                }
            )


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 1 << 18, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim match of every benchmark suffix in all shards, with one place of it:
    item_id, item_start, n_words, doc_id, doc_start (in words). Suffixes without any known word
    have no row; of equal matches the one with the smallest (doc_id, doc_start) stays."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id string, item_start long, n_words long, doc_id {kind}, doc_start long"
    parts = [
        docs.select("doc_id", "text").mapInArrow(
            partial(_longest, block=spark.sparkContext.broadcast(block), size=shard_words), schema
        )
        for block in benchmark_blocks(benchmark, block_bytes)
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_start")).alias("best")
    return (
        found.groupBy("item_id", "item_start").agg(best)
        .select("item_id", "item_start", (-F.col("best.n")).alias("n_words"), "best.doc_id", "best.doc_start")
    )
