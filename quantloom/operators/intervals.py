"""Membership histories: from snapshots, from a change log, reconciled, screened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import is_reused_ticker, names_match
from quantloom.operators.asof import interval_join


def membership_from_snapshots(long: DataFrame) -> DataFrame:
    """Half-open intervals from composition snapshots (gaps and islands).

    A name in the first snapshot has a null start, one in the last a null end, and a name that
    leaves and returns gets a second interval. Snapshot dates are bounded by the calendar, and
    so is the number of rows per security.
    """
    days = long.select("date").distinct()
    ordered = Window.orderBy("date")
    snapshots = days.select(
        "date",
        (F.row_number().over(ordered) - 1).alias("_idx"),
        F.lead("date").over(ordered).alias("_next"),
    )
    dealt = long.select("date", "security_id").repartition("security_id")
    rows = dealt.distinct().join(F.broadcast(snapshots), "date")
    island = F.col("_idx") - F.row_number().over(
        Window.partitionBy("security_id").orderBy("_idx")
    )
    spans = rows.withColumn("_island", island).groupBy("security_id", "_island").agg(
        F.min(F.struct("_idx", "date")).alias("_first"),
        F.max(F.struct("_idx", "_next")).alias("_last"),
    )
    return spans.select(
        "security_id",
        F.when(F.col("_first._idx") > 0, F.col("_first.date")).alias("start"),
        F.col("_last._next").alias("end"),
    )


def membership_from_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Intervals from today's members and a dated log of additions and removals.

    Read backwards in time, an addition counts only if the name was a member just after it,
    and a removal only if it was not. The state after any event follows from the kind of that
    event, so the previous event (or today's membership) decides.
    """
    log = (
        changes.select(
            "date",
            F.explode(
                F.array(
                    F.struct(F.col("added").alias("security_id"), F.lit("added").alias("kind")),
                    F.struct(F.col("removed").alias("security_id"), F.lit("removed").alias("kind")),
                )
            ).alias("_e"),
        )
        .select("date", "_e.*")
        .where("security_id is not null")
        .distinct()
    )
    today = current.select("security_id").distinct().withColumn("_now", F.lit(True))
    backward = Window.partitionBy("security_id").orderBy(F.desc("date"), "kind")
    seen = backward.rowsBetween(Window.unboundedPreceding, -1)
    start_kind = F.when(F.col("_now"), "removed").otherwise("added")
    events = (
        log.join(today, "security_id", "left")
        .withColumn("_after", F.coalesce(F.lag("kind").over(backward), start_kind))
        .withColumn("_counts", F.col("kind") != F.col("_after"))
        .withColumn(
            "_closed",
            F.last(
                F.when(F.col("_counts") & (F.col("kind") == "removed"), F.col("date")),
                ignorenulls=True,
            ).over(seen),
        )
    )
    joined = events.where("_counts and kind = 'added'").select(
        "security_id", F.col("date").alias("start"), F.col("_closed").alias("end")
    )
    # Names still members before the log begins: the earliest event is a removal.
    oldest = events.groupBy("security_id").agg(
        F.min_by("kind", F.struct("date", F.when(F.col("kind") == "added", 1).otherwise(0))).alias(
            "_kind"
        ),
        F.min(F.when(F.col("_counts") & (F.col("kind") == "removed"), F.col("date"))).alias("_end"),
    )
    before_log = oldest.where("_kind = 'removed'").select(
        "security_id", F.lit(None).cast("date").alias("start"), F.col("_end").alias("end")
    )
    untouched = today.join(log.select("security_id").distinct(), "security_id", "left_anti").select(
        "security_id",
        F.lit(None).cast("date").alias("start"),
        F.lit(None).cast("date").alias("end"),
    )
    return joined.unionByName(before_log).unionByName(untouched)


def reconcile_with_current(membership: DataFrame, current: DataFrame, as_of) -> DataFrame:
    """Open intervals of names that are no longer members end at ``as_of``; members without an
    open interval start there. ``as_of`` is a date or a one-row column."""
    moment = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    today = current.select("security_id").distinct()
    flagged = membership.join(today.withColumn("_now", F.lit(True)), "security_id", "left")
    closed = flagged.select(
        "security_id",
        "start",
        F.when(F.col("end").isNull() & F.col("_now").isNull(), moment)
        .otherwise(F.col("end"))
        .alias("end"),
    )
    still_open = closed.where("end is null").select("security_id")
    new = today.join(still_open, "security_id", "left_anti").select(
        "security_id", moment.alias("start"), F.lit(None).cast("date").alias("end")
    )
    return closed.unionByName(new)


def best_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first source that has any, with its note in ``source``."""
    tagged = None
    for rank, (note, df) in enumerate(sources):
        part = df.withColumn("source", F.lit(note)).withColumn("_rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.select(F.min("_rank")).scalar()
    return tagged.where(F.col("_rank") == first).drop("_rank")


def membership_window(membership: DataFrame, start) -> DataFrame:
    """Intervals that reach into the window, without tagged earlier owners of a ticker."""
    moment = start if not isinstance(start, str) else F.lit(start).cast("date")
    return membership.where(F.col("end").isNull() | (F.col("end") > moment)).where(
        ~is_reused_ticker(F.col("security_id").cast("string"))
    )


def recycled_tickers(prices: DataFrame, membership: DataFrame) -> DataFrame:
    """Names without an open interval whose first price is not before their last interval's
    end: another company that took over the ticker."""
    first = prices.where("close is not null").groupBy("security_id").agg(
        F.min("date").alias("first_price")
    )
    ends = membership.groupBy("security_id").agg(
        F.max("end").alias("last_end"), F.bool_or(F.col("end").isNull()).alias("has_open")
    )
    return (
        first.join(ends, "security_id")
        .where("not has_open and first_price >= last_end")
        .select("security_id", "first_price", "last_end")
    )


def missing_members(current: DataFrame, prices: DataFrame, max_share: float = 0.05) -> DataFrame:
    """Counts behind the guard: current members, those without prices, and whether the share
    without prices is acceptable."""
    priced = prices.where("close is not null").select("security_id").distinct()
    flags = current.select("security_id").distinct().join(
        priced.withColumn("_has", F.lit(True)), "security_id", "left"
    )
    counted = flags.agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("_has").isNull()).alias("missing")
    )
    limit = F.greatest(F.col("members"), F.lit(1)) * F.lit(max_share)
    return counted.withColumn("acceptable", F.col("missing") <= limit)


def coverage_by_year(
    calendar: DataFrame, membership: DataFrame, prices: DataFrame, facts: DataFrame
) -> DataFrame:
    """Per year end: members, share with prices, share with prices and statements."""
    ends = calendar.select(F.year("date").alias("year")).distinct().withColumn(
        "as_of_date", F.make_date("year", F.lit(12), F.lit(31))
    )
    spans = interval_join(ends, membership, "as_of_date", points_are_dates=True)
    members = spans.select("year", "security_id").distinct()
    priced = prices.where("close is not null").select("security_id").distinct()
    filed = facts.select("security_id").distinct()
    flagged = members.join(priced.withColumn("_p", F.lit(1.0)), "security_id", "left").join(
        filed.withColumn("_f", F.lit(1.0)), "security_id", "left"
    )
    zero = F.lit(0.0)
    both = F.when(F.col("_p").isNotNull() & F.col("_f").isNotNull(), 1.0).otherwise(zero)
    return flagged.groupBy("year").agg(
        F.count(F.lit(1)).alias("members"),
        F.avg(F.coalesce("_p", zero)).alias("with_prices"),
        F.avg(both).alias("with_prices_and_fundamentals"),
    )


def resolve_company_ids(
    securities: DataFrame, by_ticker: DataFrame, by_name: DataFrame
) -> DataFrame:
    """Company number per security with the method that found it, most reliable first.

    ``securities``: security_id, is_current, listed_cik, removed_name, removed_key (normalised
    name). ``by_ticker``: security_id, ticker_cik, ticker_title. ``by_name``: name_key,
    companies, only_cik.
    """
    joined = securities.join(by_ticker, "security_id", "left").join(
        by_name, F.col("removed_key") == F.col("name_key"), "left"
    )
    current = F.coalesce("is_current", F.lit(False))
    listed = current & F.col("listed_cik").isNotNull()
    has_ticker = F.col("ticker_cik").isNotNull()
    named = F.coalesce(F.col("removed_name") != "", F.lit(False))
    checked = named & has_ticker & names_match("ticker_title", "removed_name")
    unique = named & F.coalesce(F.col("companies") == 1, F.lit(False))
    # The labels of the five methods, in order of trust.
    method = (
        F.when(listed, "wikipedia")
        .when(current & has_ticker, "sec_ticker")
        .when(checked, "sec_ticker_name_checked")
        .when(unique, "sec_name_lookup")
        .when(has_ticker, "sec_ticker_unverified")
        .otherwise("unresolved")
    )
    out = joined.withColumn("method", method)
    cik = (
        F.when(F.col("method") == "wikipedia", F.col("listed_cik"))
        .when(F.col("method") == "sec_name_lookup", F.col("only_cik"))
        .when(F.col("method") != "unresolved", F.col("ticker_cik"))
    )
    return out.select("security_id", cik.alias("cik"), "method")
