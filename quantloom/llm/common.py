"""Helpers of the corpus operators: staged tables, words as bytes, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import checkpoint_folder

#: A-Z to a-z; everything but 0-9, letters and bytes of non-ASCII characters to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine without one gets its own."""
    folder = checkpoint_folder(spark)
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_BYTES).split() if text else []


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-case words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text (``bytes.split`` has this very set)."""
    return text.lower().split() if text else []


def binary(column) -> list[bytes | None]:
    """Values of an Arrow text column as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task builds from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, 255 standing for the next of the larger ones behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(held: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(held, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(held, np.int64, offset=size)
    return counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (multiply and shift, wrapping)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def token_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], buckets: int
) -> DataFrame:
    """Adds what stands before each row in its group: ``sums`` maps a new column to the column
    summed (``"1"`` counts), in the order of ``order``, whose first column is a uniform 64-bit hash.

    No group meets one task: the hash cuts each group into ``buckets`` ranges, a window runs inside
    ``(group, range)`` only, and the offsets come from a table of one row per ``(group, range)``.
    """
    bits = max(1, (buckets - 1).bit_length())
    df = df.withColumn("_bucket", F.shiftright(F.col(order[0]), 64 - bits).cast("int"))
    groups = [*keys, "_bucket"]
    value = lambda c: F.lit(1).cast("long") if c == "1" else F.col(c).cast("long")
    totals = df.groupBy(*groups).agg(*(F.sum(value(c)).alias(f"_all_{n}") for n, c in sums.items()))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, *(F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_off_{n}") for n in sums)
    )
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumns({f"_in_{n}": F.coalesce(F.sum(value(c)).over(inside), F.lit(0)) for n, c in sums.items()})
    same = [ranked[k].eqNullSafe(offsets[k]) for k in groups]
    joined = ranked.join(offsets, same).select(
        *(ranked[c] for c in df.columns if c != "_bucket"),
        *((ranked[f"_in_{n}"] + offsets[f"_off_{n}"]).alias(n) for n in sums),
    )
    return joined
