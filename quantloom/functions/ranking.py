"""Distributed exact ranks and quantiles inside groups of any size.

A window partitioned by the group alone puts a whole cross-section (every security on one
date) into one task. Here a group is cut into *value buckets* by a fixed monotone function of
the value, so

1. equal values are first folded to one row with a count (partial aggregation before the
   shuffle: a value shared by a third of the rows costs one row per map task),
2. bucket totals give the offset of each bucket (a table of at most a few thousand rows per
   group), and
3. the only sort runs inside ``(group, bucket)``.

:func:`with_ranks` gives every row its rank and moves it once: the histogram is counted where the
rows are read, and the rows meet their offset and their neighbours in the same shuffle.

The bucket depends on the value alone, so a recomputed task always lands on the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_LOG_UNIT = 16
RESOLUTION = 1e6


def value_bucket(value: Column) -> Column:
    """Monotone: a larger value never gets a smaller bucket. Log-spaced around zero."""
    x = value.cast("double")
    spread = F.signum(x) * F.log1p(F.abs(x) * RESOLUTION)
    return F.floor(spread * BUCKETS_PER_LOG_UNIT).cast("long")


def rank_values(
    df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """One row per distinct ``(groups, value)``: ``n_less``, ``n_tie`` and ``n_total``.

    ``weight`` names a count column when ``df`` is already folded. Null values are left out
    and do not count.
    """
    groups = list(groups)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    folded = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(size.alias("n_tie"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    in_order = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = (
        folded.groupBy(*groups, "_bucket")
        .agg(F.sum("n_tie").alias("_in_bucket"))
        .select(
            *groups,
            "_bucket",
            (
                F.sum("_in_bucket").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
                - F.col("_in_bucket")
            ).alias("_before"),
            F.sum("_in_bucket").over(Window.partitionBy(*groups)).alias("n_total"),
        )
    )
    inside = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return folded.join(offsets, [*groups, "_bucket"]).select(
        *groups,
        value,
        (F.col("_before") + F.sum("n_tie").over(inside) - F.col("n_tie")).alias("n_less"),
        "n_tie",
        "n_total",
    )


def bucket_offsets(counts: DataFrame, groups: Sequence[str], size: str = "_h") -> DataFrame:
    """``(groups, _bucket, _before, n_total)`` from the counts of each bucket."""
    groups = list(groups)
    below = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *groups,
        "_bucket",
        (F.sum(size).over(below) - F.col(size)).alias("_before"),
        F.sum(size).over(Window.partitionBy(*groups)).alias("n_total"),
    )


def beside_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the offset of their bucket, dealt by ``keys`` for the windows that follow.

    The small side is hashed per partition: a sort-merge join would sort the rows once more, and a
    join that turns into a broadcast would leave the windows to shuffle them again.
    """
    return rows.join(offsets.hint("shuffle_hash"), list(keys))


def with_ranks(
    df: DataFrame, groups: Sequence[str], value: str, counted: DataFrame | None = None
) -> DataFrame:
    """The rows whose ``value`` is known, with ``n_less``, ``n_tie`` and ``n_total``.

    ``counted``: the same rows before a shuffle of ``df``; the histogram is taken from them, so that
    the shuffle runs once.
    """
    groups = list(groups)
    keys = [*groups, "_bucket"]

    def bucketed(x: DataFrame) -> DataFrame:
        return x.where(F.col(value).isNotNull()).withColumn("_bucket", value_bucket(F.col(value)))

    rows = bucketed(df)
    counts = bucketed(df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"))
    in_order = Window.partitionBy(*keys).orderBy(value)
    up_to = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = beside_offsets(rows, bucket_offsets(counts, groups), keys)
    ranked = placed.select(
        *df.columns,
        "_before",
        F.rank().over(in_order).cast("long").alias("_first"),
        F.count(F.lit(1)).over(up_to).alias("_last"),
        "n_total",
    )
    return ranked.select(
        *df.columns,
        (F.col("_before") + F.col("_first") - 1).alias("n_less"),
        (F.col("_last") - F.col("_first") + 1).alias("n_tie"),
        "n_total",
    )


def mid_rank() -> Column:
    """Average rank of a row of :func:`rank_values`."""
    return F.col("n_less") + (F.col("n_tie") + 1) / F.lit(2.0)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that agree in ``keys`` in one partition, few such groups in each. The number is fixed: adaptive
    execution would join partitions by the size of their packed rows, and the sorts of the unpacked ones spill."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def mid_rank_over(group: Sequence[str | Column], value: str) -> Column:
    """Average rank of ``value`` among the rows of ``group``, for rows dealt by that group (or a part
    of its columns) already: a sort where they lie, which spills, and no shuffle."""
    in_order = Window.partitionBy(*group).orderBy(value)
    up_to = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.rank().over(in_order)
    return first + (F.count(F.lit(1)).over(up_to) - first) / F.lit(2.0)


def quantiles_of_ranked(
    ranked: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles from a :func:`rank_values` table."""
    picks = []
    for name, p in probabilities.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_tie"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
    wide = ranked.groupBy(*groups).agg(F.max("n_total").alias("n_total"), *picks)
    out = []
    for name, p in probabilities.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return wide.select(*groups, "n_total", *out)


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    return quantiles_of_ranked(rank_values(df, groups, value), groups, value, probabilities)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"):
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    renamed = right.select(
        *[
            F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
            for c in right.columns
        ]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` plus the average rank of ``value`` inside each group (null stays null)."""
    ranked = rank_values(df, groups, value).select(*groups, value, mid_rank().alias(out))
    return df.join(ranked, [*groups, value], "left")


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str):
    """Unpivot numeric columns to ``(keys, name, value)`` as doubles."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), list(columns), name, value)


def wide_form(
    df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Mapping[str, str]
) -> DataFrame:
    """Inverse of :func:`long_form` for a known list: ``columns`` maps output to name."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == src, F.col(value))).alias(out) for out, src in columns.items()]
    )


def with_percentiles(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Average-rank percentiles ``(rank - 0.5) / count`` of several columns at once.

    ``columns`` maps the new column to its source. ``keys`` identify a row and include the
    group. All columns share one pass: they are unpivoted and ranked by ``(group, column)``.
    """
    keys, group = list(keys), list(group)
    base = df.drop(*[c for c in columns if c in df.columns])
    sources = sorted(set(columns.values()))
    long = long_form(df, keys, sources, "_metric", "_value").where("_value is not null")
    scored = with_ranks(long, [*group, "_metric"], "_value").select(
        *keys, "_metric", ((mid_rank() - 0.5) / F.col("n_total")).alias("_pct")
    )
    wide = wide_form(scored, keys, "_metric", "_pct", columns)
    return base.join(wide, keys, "left")


def first_rank(
    df: DataFrame, groups: Sequence[str], value: str, tie: str, out: str, tie_span: int = 4096
) -> DataFrame:
    """Ranks 1..n with ties broken by the unique column ``tie``; null values stay null.

    ``tie_span`` is kept for callers; rows are no longer cut by it.
    """
    groups = list(groups)
    keys = [*groups, "_bucket"]
    rows = df.where(F.col(value).isNotNull()).withColumn("_bucket", value_bucket(F.col(value)))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"))
    placed = beside_offsets(rows, bucket_offsets(counts, groups), keys)
    inside = Window.partitionBy(*keys).orderBy(value, tie)
    return placed.select(
        *df.columns,
        (F.col("_before") + F.row_number().over(inside)).alias(out),
        F.col("n_total").alias(f"{out}_n"),
    )


def equal_count_bucket(rank: Column, n: Column, bins: int = 5) -> Column:
    """Zero-based bucket of ranks 1..n cut at interpolated quantiles of the ranks."""
    raw = F.ceil((rank - 1) * F.lit(float(bins)) / (n - 1)) - 1
    return F.when(n > 1, F.greatest(raw, F.lit(0))).otherwise(F.lit(0)).cast("int")
