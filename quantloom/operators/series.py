"""Per-security time series on the trading calendar.

Every lookback is a *calendar position*, not a row number: windows are ``RANGE`` frames on
``pos``, so a security that did not trade on the earlier date gives null. One partition holds
one security's bars, which the calendar bounds; all features of a security share that one
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import DAILY, Bars
from quantloom.functions.scalars import ratio


def by_position(key: str = "security_id", pos: str = "pos"):
    return Window.partitionBy(key).orderBy(pos)


def densify(
    prices: DataFrame, securities: DataFrame, calendar: DataFrame, key: str = "security_id"
) -> DataFrame:
    """One row per security and calendar date, price columns null where it did not trade."""
    last = calendar.select(F.max("pos")).scalar()
    grid = securities.select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos")
    )
    dated = grid.join(F.broadcast(calendar), "pos")
    extra = [c for c in prices.columns if c not in (key, "pos", "date")]
    return dated.join(prices.select(key, "date", *extra), [key, "date"], "left")


def value_at(c: str | Column, back: int, key: str = "security_id") -> Column:
    """The value exactly ``back`` calendar positions earlier, or null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.first(x).over(by_position(key).rangeBetween(-back, -back))


def lagged_return(close: str, skip: int, lookback: int, key: str = "security_id") -> Column:
    """``close[pos - skip] / close[pos - lookback] - 1``."""
    return ratio(value_at(close, skip, key), value_at(close, lookback, key)) - 1.0


def simple_return(close: str, key: str = "security_id") -> Column:
    return ratio(F.col(close), value_at(close, 1, key)) - 1.0


def with_returns(prices: DataFrame, close: str = "close", out: str = "ret") -> DataFrame:
    return prices.withColumn(out, simple_return(close))


def forward_fill(c: str, key: str = "security_id", pos: str = "pos") -> Column:
    frame = by_position(key, pos).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(c, ignorenulls=True).over(frame)


def trailing(key: str, rows: int):
    """The last ``rows`` calendar positions including the current one."""
    return by_position(key).rangeBetween(-(rows - 1), 0)


def realised_volatility(
    close: str, returns: int, periods: int, key: str = "security_id"
) -> Column:
    """Annualised deviation of log returns; give it a column made by :func:`log_return`."""
    return F.stddev_samp(close).over(trailing(key, returns)) * F.lit(float(periods) ** 0.5)


def log_return(close: str, key: str = "security_id") -> Column:
    return F.ln(close) - F.ln(value_at(close, 1, key))


def equal_weight_returns(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Cross-sectional mean return per date (partial aggregation, any number of names)."""
    return returns.groupBy("date").agg(F.avg(ret).alias("benchmark_return"))


def price_features(
    grid: DataFrame,
    benchmark: DataFrame | None = None,
    bars: Bars = DAILY,
    key: str = "security_id",
) -> DataFrame:
    """Price, liquidity, volatility, momentum, beta and 52-week features on a dense grid.

    ``grid`` has ``close`` (adjusted, for returns), ``price_close`` (traded, for levels),
    ``volume`` and ``pos``. ``benchmark`` is ``(date, benchmark_return)``; without one the
    equal-weight mean of the grid is used.
    """
    year = float(bars.periods_per_year) ** 0.5
    rets = grid.withColumn("ret", simple_return("close", key)).withColumn(
        "log_ret", log_return("close", key)
    )
    bench = benchmark if benchmark is not None else equal_weight_returns(rets)
    # One row per trading date: bounded by the calendar, hence the broadcast.
    dated = rets.join(
        F.broadcast(bench.select("date", F.col("benchmark_return").alias("_b"))), "date", "left"
    )
    span = trailing(key, bars.year)
    closes = trailing(key, bars.year + 1)
    n = F.least(F.col("pos"), F.lit(bars.year))
    enough = F.when(n > 0, F.count("ret").over(span) / n >= 0.8)
    # A security without a return on a benchmark day counts as 0 there, so only the sums
    # over its own rows are needed next to the benchmark's sums.
    held = F.when(F.col("_b").isNotNull(), F.coalesce("ret", F.lit(0.0)))
    n_b = F.count("_b").over(span)
    s_b, s_bb = F.sum("_b").over(span), F.sum(F.col("_b") * F.col("_b")).over(span)
    s_r, s_rb = F.sum(held).over(span), F.sum(held * F.col("_b")).over(span)
    var_b = s_bb - s_b * s_b / n_b
    beta = F.when((n_b >= bars.min_beta_rows) & (var_b > 0), (s_rb - s_r * s_b / n_b) / var_b)
    return dated.select(
        *grid.columns,
        "ret",
        F.col("price_close").alias("price"),
        F.avg(F.col("price_close") * F.col("volume")).over(trailing(key, bars.adv)).alias("adv_usd"),
        realised_volatility("log_ret", bars.volatility, bars.periods_per_year, key).alias(
            "volatility_63d"
        ),
        lagged_return("close", bars.month, bars.year, key).alias("mom_12_1"),
        lagged_return("close", 0, 6 * bars.month, key).alias("mom_6m"),
        lagged_return("close", 0, 3 * bars.month, key).alias("mom_3m"),
        lagged_return("close", 0, bars.month, key).alias("ret_1m"),
        F.when(enough, F.stddev_samp("ret").over(span) * F.lit(year)).alias("volatility_252d"),
        F.when(enough, beta).alias("beta_252d"),
        F.when(enough, ratio("close", F.max("close").over(closes))).alias("high_52w_ratio"),
    )


def moving_average(c: str, rows: int, key: str = "security_id", order: str = "pos") -> Column:
    """Mean of the last ``rows`` existing rows, only once that many exist."""
    frame = by_position(key, order)
    full = F.row_number().over(frame) >= rows
    return F.when(full, F.avg(c).over(frame.rowsBetween(-(rows - 1), 0)))


def cumulative_growth(ret: str, keys: Sequence[str], order: str, start: float = 1.0) -> Column:
    """``start`` times the running product of ``1 + ret``; a null return counts as 0."""
    frame = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return F.lit(start) * F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(frame)


def drawdown(level: str, keys: Sequence[str], order: str) -> Column:
    frame = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return F.col(level) / F.max(level).over(frame) - 1.0


def rebase(c: str, keys: Sequence[str], order: str, base: float = 100.0) -> Column:
    frame = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return F.col(c) / F.first(c, ignorenulls=True).over(frame) * F.lit(base)


def display_bars(prices: DataFrame) -> DataFrame:
    """OHLCV in traded units; the bar always contains its open and close."""
    factor = F.when(F.col("close") > 0, F.col("price_close") / F.col("close"))
    high = F.coalesce("high", F.greatest("open", "close")) if "high" in prices.columns else (
        F.greatest("open", "close")
    )
    low = F.coalesce("low", F.least("open", "close")) if "low" in prices.columns else (
        F.least("open", "close")
    )
    scaled = prices.select(
        "security_id",
        "date",
        (F.col("open") * factor).alias("open"),
        (high * factor).alias("high"),
        (low * factor).alias("low"),
        F.col("price_close").alias("close"),
        "volume",
    ).dropna(subset=["open", "close"])
    return scaled.withColumn("high", F.greatest("high", "open", "close")).withColumn(
        "low", F.least("low", "open", "close")
    )


def align_index(calendar: DataFrame, index: DataFrame, value: str = "close") -> DataFrame:
    """Index levels on every trading date, carried forward over gaps."""
    frame = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = calendar.join(index, "date", "left")
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def universe_benchmark(
    returns: DataFrame, membership: DataFrame | None, initial: float = 1.0
) -> DataFrame:
    """Equal-weight index over names that were members on the *previous* trading date."""
    from quantloom.operators.asof import interval_join

    rows = returns.select("security_id", "date", "pos", "ret")
    days = rows.select("date", "pos").distinct()
    if membership is not None:
        previous = days.select(F.col("date").alias("_prev"), (F.col("pos") + 1).alias("pos"))
        eligible = rows.join(F.broadcast(previous), "pos")
        rows = interval_join(eligible, membership, "_prev", on=["security_id"], how="left_semi")
    daily = days.join(rows.groupBy("date").agg(F.avg("ret").alias("ret")), "date", "left")
    # One row per trading date: a single ordered window over the calendar.
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce("ret", F.lit(0.0))
    return daily.select(
        "date", filled.alias("ret"), (F.lit(initial) * F.product(1.0 + filled).over(running)).alias("level")
    )


def last_quotes(prices: DataFrame, calendar: DataFrame, grace: int = 5) -> DataFrame:
    """Names whose last quote precedes the end of the window: the final position, and the
    first position at which they are due for liquidation."""
    end = calendar.select(F.max("pos")).scalar()
    final = (
        prices.where(F.col("close").isNotNull())
        .groupBy("security_id")
        .agg(F.max("pos").alias("last_pos"), F.max_by("close", "pos").alias("last_close"))
    )
    return final.where(F.col("last_pos") < end).withColumn(
        "liquidation_pos", F.col("last_pos") + grace + 1
    )


def candles(bars: DataFrame, key: str = "security_id") -> DataFrame:
    """One row per security with an array per field, dates ascending.

    Prices of at least 1 keep two decimals, smaller ones four. A group is one security's bars.
    """

    def prices_of(field: str) -> Column:
        def price(bar: Column) -> Column:
            x = bar[field]
            return F.when(x >= 1, F.round(x, 2)).otherwise(F.round(x, 4))

        return F.transform("_bars", price).alias(field)

    packed = bars.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.struct("date", "open", "high", "low", "close", "volume"))
        ).alias("_bars")
    )
    return packed.select(
        key,
        F.lit("columnar").alias("format"),
        F.transform("_bars", lambda b: F.date_format(b["date"], "yyyy-MM-dd")).alias("time"),
        *[prices_of(f) for f in ("open", "high", "low", "close")],
        F.transform("_bars", lambda b: F.coalesce(b["volume"], F.lit(0.0)).cast("long")).alias(
            "volume"
        ),
    )


def decision_changes(points: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows whose decision differs from the previous known one of the same security."""
    before = Window.partitionBy("security_id").orderBy(date).rowsBetween(
        Window.unboundedPreceding, -1
    )
    previous = F.last("decision", ignorenulls=True).over(before)
    return (
        points.withColumn("previous_decision", previous)
        .where(
            F.col("decision").isNotNull()
            & ~F.col("decision").eqNullSafe(F.col("previous_decision"))
        )
    )
