"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover the whole of it. In each chunk learned
filters run over embedded bytes and the largest response of each filter is kept; a dense layer turns
these into chunk features, whose maxima over the chunks of a document give one probability. The
network learns from a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of at most
``SAMPLE_BYTES`` bytes each, the smallest of a hash); scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import binary, text_bytes

CHUNK, STEP, WIDTH, STRIDE = 256, 224, 8, 4
EMBED, FILTERS, HIDDEN = 4, 32, 16
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32768
STEPS, BATCH, RATE, SEED = 900, 32, 0.01, 7
GROUP = 1024
THRESHOLD = 0.3
FOLDS = 5

_OFFSETS = np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)


def chunks(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each chunk, part of each chunk that is filled, first chunk of
    each text). The last chunk ends with the text; one shorter than a chunk is filled up with 256."""
    parts, starts, fills, firsts, at = [], [], [], [], 0
    for text in texts:
        size = len(text or b"")
        held = np.frombuffer(text or b"", np.uint8).astype(np.int16)
        if size < CHUNK:
            held = np.concatenate((held, np.full(CHUNK - size, 256, np.int16)))
        firsts.append(len(starts))
        own = list(range(0, max(1, len(held) - CHUNK + 1), STEP))
        if own[-1] + CHUNK < len(held):
            own.append(len(held) - CHUNK)
        starts += [at + s for s in own]
        fills += [min(1.0, size / CHUNK)] * len(own)
        parts.append(held)
        at += len(held)
    joined = np.concatenate(parts) if parts else np.zeros(0, np.int16)
    return joined, np.array(starts, np.int64), np.array(fills, np.float32), np.array(firsts, np.int64)


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
    return {
        "embed": normal(257, EMBED, k=0.5),
        "filters": normal(WIDTH * EMBED, FILTERS, k=0.3),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "dense": normal(FILTERS + 1, HIDDEN, k=0.25),
        "dense_bias": np.full(HIDDEN, 0.1, np.float32),
        "out": normal(HIDDEN, k=0.2),
        "out_bias": np.zeros(1, np.float32),
    }


def responses(model: dict, bytes_: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: largest response of each filter, where it is, and the bytes of all places."""
    seen = bytes_[starts[:, None, None] + _OFFSETS]
    got = model["embed"][seen].reshape(len(starts) * len(_OFFSETS), -1) @ model["filters"]
    got = got.reshape(len(starts), len(_OFFSETS), -1)
    where = got.argmax(1)
    return np.take_along_axis(got, where[:, None], 1)[:, 0] + model["filter_bias"], where, seen


def probabilities(model: dict, texts: list[bytes | None]) -> np.ndarray:
    """One probability for each text; chunks are taken in groups of bounded size."""
    if not texts:
        return np.zeros(0)
    bytes_, starts, fills, firsts = chunks(texts)
    features = np.empty((len(starts), HIDDEN), np.float32)
    for g in range(0, len(starts), GROUP):
        top, _, _ = responses(model, bytes_, starts[g : g + GROUP])
        inside = np.concatenate((np.maximum(top, 0), fills[g : g + GROUP, None]), 1)
        features[g : g + GROUP] = np.maximum(inside @ model["dense"] + model["dense_bias"], 0)
    logit = np.maximum.reduceat(features, firsts) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))


def gradients(model: dict, texts: list[bytes | None], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss. Only the places that win a maximum carry a gradient."""
    bytes_, starts, fills, firsts = chunks(texts)
    top, where, seen = responses(model, bytes_, starts)
    inside = np.concatenate((np.maximum(top, 0), fills[:, None]), 1)
    hidden = np.maximum(inside @ model["dense"] + model["dense_bias"], 0)
    ends = [*firsts[1:], len(starts)]
    best = np.stack([a + hidden[a:b].argmax(0) for a, b in zip(firsts, ends, strict=True)])
    pooled = np.take_along_axis(hidden, best, 0)
    logit = pooled @ model["out"] + model["out_bias"]
    error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / len(labels)).astype(np.float32)
    back = np.zeros_like(hidden)
    np.add.at(back, (best, np.arange(HIDDEN)[None]), error[:, None] * model["out"])
    back *= hidden > 0
    on = np.flatnonzero(back.any(1))
    back = back[on]
    down = (back @ model["dense"].T)[:, :FILTERS] * (top[on] > 0)
    won = seen[on[:, None], where[on]]  # chunk, filter, width
    embedded = model["embed"][won].reshape(len(on), FILTERS, -1)
    to_embed = (down[:, :, None] * model["filters"].T[None]).reshape(-1, EMBED)
    flat = won.reshape(-1)
    return {
        "embed": np.stack([np.bincount(flat, to_embed[:, k], 257) for k in range(EMBED)], 1).astype(np.float32),
        "filters": np.einsum("cf,cfe->ef", down, embedded),
        "filter_bias": down.sum(0),
        "dense": inside[on].T @ back,
        "dense_bias": back.sum(0),
        "out": pooled.T @ error,
        "out_bias": error.sum(keepdims=True),
    }


def trained(texts: list[bytes], labels: list[int], steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam over batches in a fixed random order; the same rows give the same network. Without rows
    the network answers one half."""
    rng = np.random.default_rng(SEED)
    model = fresh(rng)
    if not texts:
        return model | {"out": np.zeros(HIDDEN, np.float32)}
    y = np.array(labels, np.float32)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    order = rng.permutation(len(texts))
    at = 0
    for step in range(1, steps + 1):
        if at + BATCH > len(order):
            order, at = rng.permutation(len(texts)), 0
        batch = order[at : at + BATCH]
        at += BATCH
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in gradients(model, [texts[i] for i in batch], y[batch]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] = model[k] - (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> dict:
    """The network of a bounded sample of labelled rows that are not held out. Null ids, labels and
    texts teach nothing; of repeated rows all may."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id", "quality").limit(2 * rows)
    have = docs.where(F.col("text").isNotNull() & (text_bytes() <= most_bytes)).select("doc_id", "text")
    sample = have.join(F.broadcast(chosen), "doc_id").orderBy("_h", "doc_id", "quality", "text").limit(rows).collect()
    return trained([r.text.encode() for r in sample], [int(r.quality) for r in sample], steps)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``row`` (all columns of ``docs`` as they are) and ``score``, the probability of label 1.

    Null and empty texts have the score of an empty chunk; repeated rows a row each; an empty table
    none. Only the text is read for the score; columns named like the results stay inside ``row``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column("text"))
            got = np.zeros(len(texts))
            first, held_bytes = 0, 0
            for i, text in enumerate(texts):  # texts are taken together up to some MB
                held_bytes += len(text or b"")
                if held_bytes > 4 << 20 or i == len(texts) - 1:
                    got[first : i + 1] = probabilities(held.value, texts[first : i + 1])
                    first, held_bytes = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got)], names=["row", "score"])

    schema = frame.select("row", F.lit(0.0).alias("score")).schema
    for field in schema.fields:
        field.nullable = True
    return frame.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = fitted(docs, labels, **fit)
    return scored(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """``docs`` without the documents that the network rejects."""
    return scored(docs, fitted(docs, labels, **fit)).where(F.col("score") >= THRESHOLD).select("row.*")
