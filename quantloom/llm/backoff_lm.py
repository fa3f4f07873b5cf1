"""Language-model scoring with a weighted backoff automaton.

The model is the n-grams of all training texts. Its states are contexts (n-grams one shorter than
the order, and their suffixes down to the empty one); an n-gram seen in training is an arc with its
smoothed probability; a state without an arc for a word fails over to its suffix at the cost of its
backoff weight. A text is scored by one traversal from left to right that carries the state.

The model is never in one place. Texts are dealt into blocks; each block asks the parts of the model
for the n-grams it holds, one packed row for each (block, part): sorted 64-bit hashes, and what the
block adds to their training counts. A part sums the counts over all blocks and answers each block
with the totals of just its n-grams, from which the block builds the piece of the automaton that its
texts can reach. Rows grow with the corpus, none with the frequency of an n-gram.

Smoothing: Dirichlet priors, P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), with additive smoothing of
the single words below, so every distribution sums to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import binary, mix, packed, text_bytes, tokens_of, unpacked

ADD = 0.1
#: Weight of the shorter context, for orders 2, 3, ...
PRIOR = (200.0,)
BLOCK_BYTES, PART_BYTES = 6 << 20, 16 << 20
FOLDS = 10
END, BEGIN = 0, 1


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0, F.lit(False))


class Grams:
    """The n-grams of a block. ``ids[k]``: at each place the number of the n-gram of order k + 1 that
    ends there, -1 where history is too short; ``hashes[k]``, ``context[k]``, ``suffix[k]`` by number."""

    def __init__(self, texts: list[bytes | None], order: int):
        number: dict[bytes, int] = {}
        parts, sizes = [], []
        for text in texts:
            words = tokens_of(text)
            parts.append([BEGIN, *(number.setdefault(w, len(number) + 2) for w in words), END])
            sizes.append(len(words) + 2)
        self.sizes = np.array(sizes, np.int64)
        self.at = np.array([i for p in parts for i in p], np.int64)
        self.words = len(number) + 2
        # The ends of texts have hashes no word has by chance.
        single = np.array([xxhash.xxh64_intdigest(b"\n<end>"), xxhash.xxh64_intdigest(b"\n<begin>"), *map(xxhash.xxh64_intdigest, number)], np.uint64)
        self.ids, self.hashes, self.context, self.suffix = [self.at], [single], [None], [None]
        for k in range(1, order):
            ends = np.flatnonzero((self.ids[k - 1][:-1] >= 0) & (self.at[1:] != BEGIN) & (self.at[:-1] != END)) + 1
            key = self.ids[k - 1][ends - 1] * self.words + self.at[ends]
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            ids = np.full(len(self.at), -1, np.int64)
            ids[ends] = which
            place = ends[first]
            context, word = self.ids[k - 1][place - 1], self.at[place]
            step = np.uint64(0xD6E8FEB86659FD93 + 2 * k)
            self.hashes.append(mix(mix(self.hashes[k - 1][context]) * step + single[word]))
            self.context.append(context)
            self.suffix.append(self.ids[k - 1][place])
            self.ids.append(ids)

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often the training texts of the block hold each n-gram, for each order."""
        on = np.repeat(train, self.sizes)
        return [np.bincount(i[on & (i >= 0)], minlength=len(h)) for i, h in zip(self.ids, self.hashes, strict=True)]


def _requests(group: pa.Table, order: int, parts: int) -> pa.Table:
    """(block, part, level, grams, counts); level 0 is the begin of texts, so that it is no word.
    Every part gets a row of level 1, for it answers with its share of the totals."""
    grams = Grams(binary(group.column("text").combine_chunks()), order)
    counts = grams.counts(~group.column("held_out").to_numpy().astype(bool))
    rows: list[tuple] = []
    levels = [(0, grams.hashes[0][[BEGIN]], counts[0][[BEGIN]])]
    for k, (h, c) in enumerate(zip(grams.hashes, counts, strict=True)):
        if k == 0:
            word = np.arange(len(h)) != BEGIN
            h, c = h[word], c[word]
        levels.append((k + 1, h, c))
    for level, h, c in levels:
        by = np.argsort(h, kind="stable")
        h, c = h[by], c[by]
        part = (h % np.uint64(parts)).astype(np.int64)
        for p in range(parts) if level == 1 else np.unique(part):
            mine = part == p
            rows.append((int(p), level, h[mine].tobytes(), packed(c[mine])))
    columns = list(zip(*rows, strict=True))
    block = group.column("block")[0].as_py()
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table(
        [pa.array([block] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
        names=["block", "part", "level", "grams", "counts"],
    )


def _answers(group: pa.Table) -> pa.Table:
    """The totals of each request of one part, and the part's training words and distinct ones."""
    level = group.column("level").to_numpy()
    asked = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
    added = [unpacked(c, len(g)) for c, g in zip(group.column("counts").to_pylist(), asked, strict=True)]
    totals: list[bytes] = [b""] * len(asked)
    words = distinct = 0
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        known, which = np.unique(np.concatenate([asked[r] for r in rows]), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, which, np.concatenate([added[r] for r in rows]))
        at = 0
        for r in rows:
            totals[r] = packed(total[which[at : at + len(asked[r])]])
            at += len(asked[r])
        if k == 1:
            words, distinct = int(total.sum()), int((total > 0).sum())
    n = len(asked)
    return pa.table(
        {
            "block": group.column("block"), "part": group.column("part"), "level": group.column("level"),
            "totals": pa.array(totals, pa.binary()), "words": pa.array([words] * n, pa.int64()), "distinct": pa.array([distinct] * n, pa.int64()),
        }
    )


class Automaton:
    """The part of the model that the texts of one block can reach. State 0 is the empty context."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], words: int, distinct: int, prior: tuple[float, ...]):
        order = len(grams.ids)
        below = (totals[0] + ADD) / (words + ADD * (distinct + 1))
        self.root = np.log10(below)
        self.stride = grams.words
        # A context that training never saw has no state: its longest seen suffix stands for it.
        state = np.zeros(grams.words, np.int64)
        seen = np.flatnonzero(totals[0] > 0)
        seen = seen[seen != END]
        state[seen] = 1 + np.arange(len(seen))
        states, n = [state], 1 + len(seen)
        fail, weight = [np.zeros(1 + len(seen), np.int64)], [np.concatenate(([0.0], self.bow(totals[0][seen], prior[0])))]
        for k in range(1, order - 1):
            own = states[k - 1][grams.suffix[k]].copy()
            seen = np.flatnonzero((totals[k] > 0) & (grams.at[self.last(grams, k)] != END))
            fail.append(states[k - 1][grams.suffix[k][seen]])
            weight.append(self.bow(totals[k][seen], prior[k]))
            own[seen] = n + np.arange(len(seen))
            n += len(seen)
            states.append(own)
        self.next_of_word = states[0].tolist()
        self.fail, self.weight = np.concatenate(fail).tolist(), np.concatenate(weight).tolist()
        self.arcs: dict[int, tuple[float, int]] = {}
        for k in range(1, order):
            last = grams.at[self.last(grams, k)]
            history = totals[k - 1][grams.context[k]]
            smooth = prior[k - 1]
            below = (totals[k] + smooth * below[grams.suffix[k]]) / (history + smooth)
            have = np.flatnonzero(totals[k] > 0)
            onward = states[k][have] if k < order - 1 else states[k - 1][grams.suffix[k][have]]
            onward = np.where(last[have] == END, 0, onward)
            keys = states[k - 1][grams.context[k][have]] * self.stride + last[have]
            self.arcs.update(zip(keys.tolist(), zip(np.log10(below[have]).tolist(), onward.tolist(), strict=True), strict=True))
        self.start = states[0][BEGIN]

    @staticmethod
    def bow(count: np.ndarray, prior: float) -> np.ndarray:
        return np.log10(prior / (count + prior))

    @staticmethod
    def last(grams: Grams, k: int) -> np.ndarray:
        place = np.zeros(len(grams.hashes[k]), np.int64)
        on = np.flatnonzero(grams.ids[k] >= 0)
        place[grams.ids[k][on]] = on
        return place

    def score(self, words: list[int]) -> float:
        """log10 of the probability of the words, END included, after the begin of a text."""
        state, total = int(self.start), 0.0
        arcs, stride, fail, weight, root, onward = self.arcs, self.stride, self.fail, self.weight, self.root, self.next_of_word
        for word in words:
            while True:
                arc = arcs.get(state * stride + word) if state else None
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                if not state:
                    total += root[word]
                    state = onward[word]
                    break
                total += weight[state]
                state = fail[state]
        return total


def _scores(docs: pa.Table, answers: pa.Table, order: int, parts: int, prior: tuple[float, ...]) -> pa.Table:
    texts = binary(docs.column("text").combine_chunks())
    grams = Grams(texts, order)
    given: dict[tuple[int, int], bytes] = {}
    words = distinct = 0
    for row in answers.to_pylist():
        given[row["part"], row["level"]] = row["totals"]
        if row["level"] == 1:
            words, distinct = words + row["words"], distinct + row["distinct"]
    totals = []
    for k, h in enumerate(grams.hashes):
        out = np.zeros(len(h), np.int64)
        which = np.flatnonzero(np.arange(len(h)) != BEGIN) if k == 0 else np.arange(len(h))
        which = which[np.argsort(h[which], kind="stable")]
        part = (h[which] % np.uint64(parts)).astype(np.int64)
        for p in np.unique(part):
            mine = which[part == p]
            out[mine] = unpacked(given[int(p), k + 1], len(mine))
        if k == 0:
            out[BEGIN] = unpacked(given[int(h[BEGIN] % np.uint64(parts)), 0], 1)[0]
        totals.append(out)
    model = Automaton(grams, totals, words, distinct, prior)
    model.root = model.root.tolist()
    base = np.log10((totals[0] + ADD) / (words + ADD * (distinct + 1)))
    n_tokens, n_known, base_score, score = [], [], [], []
    at = 0
    for size in grams.sizes:
        own = grams.at[at + 1 : at + size]
        at += size
        n_tokens.append(len(own))
        n_known.append(int((totals[0][own] > 0).sum()))
        base_score.append(float(base[own].sum()))
        score.append(model.score(own.tolist()))
    n = len(texts)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([words] * n, pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()),
        }
    )


def language_scores(docs: DataFrame, prior: tuple[float, ...] = PRIOR, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The order of the model is one more than the number of priors. A null or empty text is its end
    alone; a null id is a training row; repeated rows count and are scored one by one; an empty table
    gives none; other columns are not read. A held-out text adds to no count.
    """
    order = len(prior) + 1
    total = docs.agg(F.sum(text_bytes() + 16)).first()[0] or 0
    blocks, parts = max(1, -(-total // block_bytes)), max(1, -(-total // part_bytes))
    dealt = docs.select(
        "doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    ).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(
        lambda group: _requests(group, order, parts), "block int, part int, level int, grams binary, counts binary"
    )
    answered = asked.groupBy("part").applyInArrow(
        lambda group: _answers(group), "block int, part int, level int, totals binary, words long, distinct long"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        lambda held, answers: _scores(held, answers, order, parts, prior), schema
    )
