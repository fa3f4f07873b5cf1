"""Point-in-time access: visibility, latest as of, nearest, intervals, range lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.calendar import day_lookup


class LookAheadError(AssertionError):
    """Data from after the decision date reached a decision."""


def visible(df: DataFrame, as_of: Date | str | Column, available: str = "available_at"):
    """Rows knowable at ``as_of``; the comparison is pushed to the scan."""
    moment = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    return df.where(F.col(available) <= moment)


def assert_point_in_time(
    df: DataFrame, as_of: Date | str, available: str = "available_at"
) -> DataFrame:
    """``df`` unchanged, or :class:`LookAheadError` with the number of future rows."""
    late = df.where(F.col(available) > F.lit(str(as_of)).cast("date")).count()
    if late:
        raise LookAheadError(f"{late} rows have {available} after {as_of}")
    return df


def guarded(df: DataFrame, as_of: Date | str | Column, available: str = "available_at") -> DataFrame:
    """``df`` with the check carried by its plan: the job that reads it, whoever runs it, fails at the
    first row that becomes known after ``as_of`` (a date, or a column with each row's own). A row
    without a time fails as well. No job runs for the check itself."""
    moment = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    known = F.coalesce(F.col(available) <= moment, F.lit(False))
    said = F.concat(F.lit(f"look-ahead: {available} "), F.coalesce(F.col(available).cast("string"), F.lit("unknown")), F.lit(" is not known at "), moment.cast("string"))
    return df.where(F.when(known, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def latest_as_of(
    df: DataFrame,
    as_of: Date | str,
    key: str = "security_id",
    order: Sequence[str] = ("available_at",),
    available: str = "available_at",
) -> DataFrame:
    """Last visible row per key for one date. ``max_by`` combines map-side, so a hot key
    costs one row per map task."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return visible(df, as_of, available).groupBy(key).agg(best).select(key, "_row.*")


@dataclass(frozen=True)
class Facts:
    """One fact table of an as-of join: which columns to bring, and how they are ordered.

    ``lag_days`` asks for the state that many days before the query date. Shifting the facts
    forward is the same comparison and keeps one schedule for all sources. ``exact`` facts count on
    their own date only. ``dealt`` says that the rows of a key lie together already.
    """

    table: DataFrame
    values: Sequence[str]
    prefix: str = ""
    lag_days: int = 0
    time: str = "available_at"
    tie: Sequence[str] = field(default_factory=tuple)
    exact: bool = False
    dealt: bool = False


def fold_to_schedule(
    sources: Sequence[Facts], schedule: DataFrame, key: str, date: str
) -> DataFrame:
    """Facts folded to at most one row per key and scheduled date, one struct per source.

    Every fact is first assigned to the first scheduled date that may see it; the newest one
    per ``(key, date)`` wins. However many facts a key has, it leaves with no more rows than
    the schedule has dates. Each table is dealt by key once, however many sources read it, and is
    folded where it lies.
    """
    first = schedule.select(F.min(date)).scalar()
    tables: dict[int, list[int]] = {}
    for i, s in enumerate(sources):
        tables.setdefault(id(s.table), []).append(i)
    tagged = None
    for numbers in tables.values():
        used = [sources[i] for i in numbers]
        columns = dict.fromkeys(c for s in used for c in (s.time, *s.values, *s.tie) if c != key)
        rows = used[0].table.select(key, *columns)
        rows = rows if all(s.dealt for s in used) else rows.repartition(key)
        offers = []
        for i, s in zip(numbers, used, strict=True):
            moved = F.date_add(s.time, s.lag_days) if s.lag_days else F.col(s.time)
            # ``greatest`` skips nulls: a fact without a time would be visible from the first date on.
            seen = F.when(F.col(s.time).isNotNull(), moved if s.exact else F.greatest(moved, first))
            offers.append(F.struct(F.lit(i).alias("nth"), F.lit(s.exact).alias("exact"), seen.alias("day")))
        each = rows.withColumn("_offer", F.explode(F.array(*offers))).where("_offer.day is not null")
        parts = []
        for i, s in zip(numbers, used, strict=True):
            own = F.col("_offer.nth") == i
            parts.append(F.when(own, F.struct(*s.values)).alias(f"_fact{i}"))
            parts.append(F.when(own, F.struct(F.col(s.time).alias("_t"), *s.tie)).alias(f"_order{i}"))
        part = each.select(key, "_offer.day", "_offer.exact", *parts)
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return (
        tagged.join(F.broadcast(day_lookup(schedule, date)), "day")
        .where("not exact or day = target")
        .groupBy(F.col(key), F.col("target").alias(date))
        .agg(
            *[
                F.max_by(f"_fact{i}", F.col(f"_order{i}")).alias(f"_fact{i}")
                for i in range(len(sources))
            ]
        )
    )


def asof_join_many(
    queries: DataFrame,
    sources: Sequence[Facts],
    schedule: DataFrame | None = None,
    key: str = "security_id",
    date: str = "as_of_date",
) -> DataFrame:
    """Every query row with the newest fact of each source visible at its own date.

    No inequality join: facts are folded to the schedule of query dates, tagged, unioned with
    the queries and carried forward in one window per key, which holds at most two rows per
    scheduled date and key. ``schedule`` (one ``date`` column covering the query dates) saves
    deriving it from the queries.
    """
    if schedule is None:
        schedule = queries.select(date).distinct()
    folded = fold_to_schedule(sources, schedule, key, date)
    asked = queries.select(
        key, date, F.lit(1).alias("_tag"), F.struct(*queries.columns).alias("_query")
    )
    both = asked.unionByName(folded.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    carried = (
        Window.partitionBy(key)
        .orderBy(date, "_tag")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # What counts on its own date only is not carried past it.
    today = Window.partitionBy(key, date).orderBy("_tag").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = [
        F.last(f"_fact{i}", ignorenulls=True).over(today if s.exact else carried).alias(f"_last{i}")
        for i, s in enumerate(sources)
    ]
    found = [
        F.col(f"_last{i}.{c}").alias(f"{s.prefix}{c}")
        for i, s in enumerate(sources)
        for c in s.values
    ]
    return both.select("_tag", "_query", *last).where("_tag = 1").select("_query.*", *found)


def asof_join(
    queries: DataFrame,
    facts: DataFrame,
    values: Sequence[str],
    schedule: DataFrame | None = None,
    key: str = "security_id",
    date: str = "as_of_date",
    time: str = "available_at",
    tie: Sequence[str] = (),
    prefix: str = "",
    lag_days: int = 0,
) -> DataFrame:
    """:func:`asof_join_many` for one fact table."""
    source = Facts(facts, values, prefix, lag_days, time, tie)
    return asof_join_many(queries, [source], schedule, key, date)


def nearest_join(
    base: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    tolerance_days: int = 7,
) -> DataFrame:
    """Nearest row of ``series`` within the tolerance; an exact tie takes the earlier one.

    Each series row is offered to the few calendar days it can serve, which makes the join an
    equality on ``(keys, day)`` whatever the number of rows per key.
    """
    reach = F.sequence(
        F.date_sub(time, tolerance_days), F.date_add(time, tolerance_days), F.expr("interval 1 day")
    )
    offers = series.select(
        *keys, F.col(time).alias("_match"), F.explode(reach).alias(time), *values
    )
    distance = F.struct(F.abs(F.datediff("_match", time)), F.col("_match"))
    best = offers.groupBy(*keys, time).agg(
        F.min_by(F.struct(F.col("_match").alias(f"matched_{time}"), *values), distance).alias("_n")
    )
    return (
        base.join(best, [*keys, time], "left")
        .select(*base.columns, F.col(f"_n.matched_{time}"), *[F.col(f"_n.{v}") for v in values])
    )


def with_months(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Half-open intervals exploded to the months they touch inside ``[low, high]``."""
    first = F.trunc(F.greatest(F.coalesce(F.col(start), low), low), "month")
    last = F.trunc(F.least(F.coalesce(F.date_sub(end, 1), high), high), "month")
    return df.where((first <= last)).withColumn(
        "_month", F.explode(F.sequence(first, last, F.expr("interval 1 month")))
    )


def in_interval(time: str, start: str, end: str) -> Column:
    """``[start, end)`` with null bounds meaning unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= F.col(time))) & (
        F.col(end).isNull() | (F.col(end) > F.col(time))
    )


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    time: str = "as_of_date",
    start: str = "start",
    end: str = "end",
    on: Sequence[str] = (),
    how: str = "inner",
    points_are_dates: bool = False,
) -> DataFrame:
    """Points inside half-open intervals, as an equality join on the month (plus ``on``).

    An interval is offered to the months between its bounds, clipped to the months in which
    points exist, and the exact test runs on the matches. ``points_are_dates`` says that the
    points are bare decision dates: bounded by the calendar, they are sent to the intervals
    instead of gathering all members of a month in one task.
    """
    low = points.select(F.min(time)).scalar()
    high = points.select(F.max(time)).scalar()
    spans = with_months(intervals, start, end, low, high)
    timed = points.withColumn("_month", F.trunc(time, "month"))
    if points_are_dates:
        timed = F.broadcast(timed)
    keys = [*on, "_month"]
    right = spans.select(*[F.col(c).alias(f"_i_{c}") if c in keys else F.col(c) for c in spans.columns])
    condition = in_interval(time, start, end)
    for k in keys:
        condition = condition & (timed[k] == right[f"_i_{k}"])
    return timed.join(right, condition, how).drop("_month", *[f"_i_{k}" for k in keys])


def members_at(dates: DataFrame, membership: DataFrame, date: str = "as_of_date") -> DataFrame:
    """``(date, security_id)`` for every member on every decision date."""
    spans = interval_join(dates.select(date), membership, date, points_are_dates=True)
    return spans.select(date, "security_id").distinct()


def overlaps(
    facts: DataFrame, intervals: DataFrame, key: str = "security_id", time: str = "event_time"
) -> DataFrame:
    """Keys with at least one fact inside one of their intervals."""
    return interval_join(facts, intervals, time, on=[key], how="left_semi").select(key).distinct()


def product_after(
    facts: DataFrame,
    events: DataFrame,
    key: str,
    time: str,
    event_time: str,
    factor: str,
    out: str,
) -> DataFrame:
    """Product of ``factor`` over events strictly later than each fact; 1 when there is none.

    Reverse running product over the few events of a key, unioned with the facts by tag.
    Events on one day are multiplied together first.
    """
    daily = events.groupBy(key, F.col(event_time).alias("_t")).agg(F.product(factor).alias("_f"))
    times = facts.select(key, F.col(time).alias("_t")).distinct()
    tagged = times.withColumn("_tag", F.lit(1)).unionByName(
        daily.withColumn("_tag", F.lit(0)), allowMissingColumns=True
    )
    # Descending time with the fact first on equal days, so only later events are multiplied.
    later = (
        Window.partitionBy(key)
        .orderBy(F.desc("_t"), F.desc("_tag"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = tagged.withColumn(out, F.coalesce(F.product("_f").over(later), F.lit(1.0)))
    found = running.where("_tag = 1").select(key, F.col("_t").alias(time), out)
    return facts.join(found, [key, time], "left")


def first_range_match(
    df: DataFrame, code: str, ranges: Sequence[tuple[int, int, str]], out: str
) -> DataFrame:
    """First listed inclusive range that holds the code; text that is no number gives null.

    The list is short and fixed, so it is a ``when`` chain inside the scan stage.
    """
    number = F.expr(f"try_cast(trim({code}) as int)")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(ranges)):
        label = F.when(number.between(low, high), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)
