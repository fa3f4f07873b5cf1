"""Trading calendar: positions, schedules, on-or-before lookups.

A calendar holds one row per distinct trading date, so its size is bounded by the number of
days in the history (36,525 in a century). That bound is what allows the ordered window
without a partition and the broadcasts in this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(prices: DataFrame, date: str = "date") -> DataFrame:
    """``(date, pos)`` with ``pos`` counting trading dates from 0."""
    days = prices.select(F.col(date).alias("date")).where("date is not null").distinct()
    return days.select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos")
    )


def with_positions(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    days = calendar.select(F.col("date").alias(date), "pos")
    return df.join(F.broadcast(days), date)


def day_lookup(schedule: DataFrame, date: str = "date") -> DataFrame:
    """``(day, target)``: each calendar day mapped to the first scheduled date on or after it."""
    ordered = Window.orderBy(date)
    spans = schedule.select(date).distinct().withColumn("_prev", F.lag(date).over(ordered))
    first_day = F.coalesce(F.date_add("_prev", 1), F.col(date))
    return spans.select(
        F.explode(F.sequence(first_day, F.col(date))).alias("day"), F.col(date).alias("target")
    )


def on_or_before(requests: DataFrame, calendar: DataFrame, date: str = "requested") -> DataFrame:
    """Adds ``trading_date``: the last calendar date not later than ``date`` (or null)."""
    ordered = Window.orderBy("date")
    spans = calendar.select(
        "date", F.lead("date").over(ordered).alias("_next")
    )
    days = spans.where("_next is not null").select(
        F.explode(F.sequence("date", F.date_sub("_next", 1))).alias(date),
        F.col("date").alias("_found"),
    )
    last = calendar.select(F.max("date")).scalar()
    return (
        requests.join(F.broadcast(days), date, "left")
        .withColumn(
            "trading_date", F.when(F.col(date) >= last, last).otherwise(F.col("_found"))
        )
        .drop("_found")
    )


def period_ends(calendar: DataFrame, frequency: str = "monthly", date: str = "date") -> DataFrame:
    """Last trading date of each month, or of each half month (day 15 ends the first half)."""
    keys = [F.year(date).alias("_y"), F.month(date).alias("_m")]
    if frequency == "biweekly":
        keys.append((F.dayofmonth(date) > 15).alias("_half"))
    elif frequency != "monthly":
        raise ValueError(f"unknown rebalance frequency: {frequency}")
    return calendar.groupBy(*keys).agg(F.max(date).alias(date)).select(date)


def schedule_index(schedule: DataFrame, date: str = "date") -> DataFrame:
    """``(date, k)``: the place of each scheduled date, from 0."""
    return schedule.select(
        date, (F.row_number().over(Window.orderBy(date)) - 1).cast("long").alias("k")
    )
