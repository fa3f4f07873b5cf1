"""The given tables read as a market.

There are no equities in the test data, so suppliers stand for securities, nations for
industries, regions for sectors and months of ``lineitem`` for bars. Sums are taken over
integers (cents, or ten-thousandths) so that a result does not depend on the order in which
partial sums arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import MONTHLY, Costs, Eligibility, RiskLimits, Sizing, Strategy
from quantloom.operators.calendar import trading_calendar, with_positions
from quantloom.plans.stage import staged

BARS = MONTHLY
STRATEGY = Strategy(
    eligibility=Eligibility(
        minimum_stock_price_usd=1500.0, min_market_cap_usd=1_200_000.0, min_adv_usd=250_000.0
    ),
    portfolio=Sizing(min_holdings=10, max_holdings=15, max_position_weight=0.12, max_sector_weight=0.35),
    risk=RiskLimits(lookback_days=24, max_industry_weight=0.20),
    costs=Costs(),
)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(x: Column, scale: int) -> Column:
    """Exact integer units of a decimal amount stored as double."""
    return F.rint(x * F.lit(float(scale))).cast("long")


def securities(spark, sf) -> DataFrame:
    supplier, nation, region = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("security_id"),
            F.col("s_name").alias("ticker"),
            F.col("r_name").alias("sector_id"),
            F.col("n_name").alias("industry_id"),
        )
    )


def lines(spark, sf) -> DataFrame:
    """Line items with the month end they belong to and their net value."""
    return read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("security_id"),
        F.to_date("l_shipdate").alias("day"),
        F.last_day("l_shipdate").alias("date"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("gross"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


MEASURES = (
    "revenue",
    "gross_profit",
    "ebitda",
    "net_income",
    "free_cash_flow",
    "invested_capital",
    "net_debt",
)


def monthly_sums(rows: DataFrame) -> DataFrame:
    """Everything the market tables need, from one pass over the line items.

    A row per supplier and month: integer sums that add up to quarters exactly, so neither the
    bars nor the statements read the line items again.
    """
    net, gross = F.col("net"), F.col("gross")
    tax = gross * F.col("l_tax")
    amounts = {
        "revenue": net,
        "gross_profit": net - 0.6 * gross,
        "ebitda": net - 0.65 * gross - tax,
        "net_income": net - 0.75 * gross - tax,
        "free_cash_flow": F.when(F.col("l_returnflag") == "R", -tax).otherwise(net - 0.7 * gross),
        "invested_capital": 2 * gross,
        "net_debt": gross * F.col("l_discount") - tax,
    }
    unit = net / F.col("qty")
    return rows.groupBy("security_id", "date").agg(
        F.sum("qty").alias("volume"),
        F.sum(units(gross, 100)).alias("gross_units"),
        F.min(F.struct("day", unit.alias("px"))).getField("px").alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_revisions_up"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_revisions_down"),
        *[F.sum(units(amounts[m], 10_000)).alias(m) for m in MEASURES],
    )


def monthly(spark, sf) -> DataFrame:
    return staged(spark, sf, "monthly", lambda: monthly_sums(lines(spark, sf)))


def bars_of(sums: DataFrame) -> DataFrame:
    """Monthly bars: ``close`` is net of discount (adjusted), ``price_close`` gross (traded)."""
    return sums.select(
        "security_id",
        "date",
        "open",
        "high",
        "low",
        (F.col("revenue") / F.lit(10_000.0) / F.col("volume")).alias("close"),
        (F.col("gross_units") / F.lit(100.0) / F.col("volume")).alias("price_close"),
        "volume",
    )


def bars(spark, sf) -> DataFrame:
    return bars_of(monthly(spark, sf))


def calendar(spark, sf) -> DataFrame:
    return staged(spark, sf, "calendar", lambda: trading_calendar(monthly(spark, sf)))


def last_position(days: DataFrame):
    """The newest position of a calendar as a scalar column."""
    return days.select(F.max("pos")).scalar()


def prices(spark, sf) -> DataFrame:
    return with_positions(bars(spark, sf), calendar(spark, sf))


def grid(spark, sf) -> DataFrame:
    from quantloom.operators.series import densify

    return densify(bars(spark, sf), securities(spark, sf), calendar(spark, sf))


def quarter_end(day: str) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def fundamentals(spark, sf) -> DataFrame:
    """Quarterly statements; filed 25 to 59 days after the quarter ends."""
    sums = (
        monthly(spark, sf)
        .groupBy("security_id", quarter_end("date").alias("event_time"))
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
    )
    lag = (25 + F.col("security_id") % 35).cast("int")
    return sums.select(
        "security_id",
        "event_time",
        F.date_add("event_time", lag).alias("available_at"),
        F.date_add("event_time", lag + 1).alias("ingested_at"),
        *[(F.col(m) / F.lit(10_000.0)).alias(m) for m in MEASURES],
    )


def shares(spark, sf) -> DataFrame:
    return (
        monthly(spark, sf)
        .groupBy("security_id", quarter_end("date").alias("_end"))
        .agg(F.sum("volume").alias("_qty"))
        .select(
            "security_id",
            F.date_add("_end", 20).alias("available_at"),
            (F.col("_qty") + 500.0).alias("shares_outstanding"),
        )
    )


def estimates(spark, sf) -> DataFrame:
    """Monthly analyst snapshots: mean net line, accepted lines up, returned lines down."""
    return monthly(spark, sf).select(
        "security_id",
        F.col("date").alias("event_time"),
        F.date_sub("date", 3).alias("available_at"),
        (F.col("revenue") / F.lit(10_000.0) / F.col("n_lines")).alias("fy1_eps_estimate"),
        "n_revisions_up",
        "n_revisions_down",
    )


def composition(spark, sf) -> DataFrame:
    """Composition snapshots: a security is a member in months in which it sold enough."""
    return monthly(spark, sf).where("volume >= 60").select("date", "security_id")


def decision_dates(spark, sf) -> DataFrame:
    return calendar(spark, sf).select(F.col("date").alias("as_of_date"))
