"""Queries on bars, as-of access, price features, statements, snapshots and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.config import FAMILIES, FEATURES
from quantloom.functions import ranking as rk
from quantloom.functions import scalars as sc
from quantloom.operators import asof, calendar as cal, crosssection as cs
from quantloom.operators import fundamentals as fu, intervals as iv, series as se
from quantloom.plans import testbed as tb
from quantloom.plans.oracle import percentile_of, percentile_sql
from quantloom.plans.pipeline import eligible_percentiles, last_date, membership, scored, signals, snapshot
from quantloom.plans.registry import query, rounded


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


# ---------------------------------------------------------------- calendar and schedules
@query("trading_calendar", "SELECT date, pos FROM t_calendar")
def _(spark, sf):
    return tb.calendar(spark, sf).select("date", "pos")


def order_days(spark, sf):
    return cal.trading_calendar(tb.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("rebalance_dates_monthly", """
SELECT max(d) AS date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
GROUP BY year(d), month(d)""")
def _(spark, sf):
    return cal.period_ends(order_days(spark, sf), "monthly")


@query("rebalance_dates_biweekly", """
SELECT max(d) AS date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
GROUP BY year(d), month(d), day(d) > 15""")
def _(spark, sf):
    return cal.period_ends(order_days(spark, sf), "biweekly")


@query("trading_date_on_or_before", """
SELECT security_id, day AS requested, n, (SELECT max(c.date) FROM t_calendar c WHERE c.date <= day) AS trading_date
FROM (SELECT security_id, day, count(*) AS n FROM t_lines GROUP BY 1, 2)""")
def _(spark, sf):
    asked = tb.lines(spark, sf).groupBy("security_id", F.col("day").alias("requested")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cal.on_or_before(asked, tb.calendar(spark, sf))


# ---------------------------------------------------------------- bars
@query("monthly_bars", "SELECT security_id, date, pos, volume, open, high, low, close, price_close FROM t_prices")
def _(spark, sf):
    return tb.prices(spark, sf).select(
        "security_id", "date", "pos", "volume", "open", "high", "low", "close", "price_close"
    )


@query("display_bars", """
SELECT security_id, date, volume, open * f AS open,
       greatest(high * f, open * f, price_close) AS high,
       least(low * f, open * f, price_close) AS low, price_close AS close
FROM (SELECT *, CASE WHEN close > 0 THEN price_close / close END AS f FROM t_bars)
WHERE open * f IS NOT NULL AND price_close IS NOT NULL""")
def _(spark, sf):
    return se.display_bars(tb.bars(spark, sf))


@query("price_history_since", """
SELECT security_id, date, volume, open * (price_close / close) AS open, price_close AS close
FROM t_bars WHERE date >= DATE '1998-01-01'""")
def _(spark, sf):
    # Not from the staged sums: the date condition reaches the scan of the line items.
    late = tb.lines(spark, sf).where("day >= DATE '1998-01-01'")
    recent = tb.bars_of(tb.monthly_sums(late))
    return se.display_bars(recent).select("security_id", "date", "volume", "open", "close")


@query("columnar_candles", f"""
SELECT security_id, 'columnar' AS format, string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS time_text,
       {r("sum(CASE WHEN price_close >= 1 THEN round(price_close, 2) ELSE round(price_close, 4) END)", "close_sum", 0)},
       count(*) AS n, CAST(sum(CAST(volume AS BIGINT)) AS BIGINT) AS volume_sum
FROM t_bars GROUP BY 1""")
def _(spark, sf):
    packed = se.candles(se.display_bars(tb.bars(spark, sf)))
    return rounded(
        packed.select(
            "security_id",
            "format",
            F.array_join("time", ",").alias("time_text"),
            # in whole ten-thousandths: exact, so that a sum ending in .5 rounds up
            (F.aggregate("close", F.lit(0).cast("long"), lambda a, x: a + tb.units(x, 10_000)) / F.lit(10_000.0)).alias("close_sum"),
            F.size("time").alias("n"),
            F.aggregate("volume", F.lit(0).cast("long"), lambda a, x: a + x).alias("volume_sum"),
        ),
        0,
    )


# ---------------------------------------------------------------- as-of family
@query("visible_statements", """
SELECT security_id, event_time, available_at, round(revenue, 4) AS revenue
FROM t_fundamentals WHERE available_at <= DATE '1998-06-30'""")
def _(spark, sf):
    seen = asof.visible(tb.fundamentals(spark, sf), "1998-06-30")
    return rounded(seen.select("security_id", "event_time", "available_at", "revenue"), 4)


@query("look_ahead_rows", """
SELECT available_at > DATE '1998-06-30' AS is_future, count(*) AS n FROM t_fundamentals GROUP BY 1""")
def _(spark, sf):
    rows, day = tb.fundamentals(spark, sf), "1998-06-30"
    seen = asof.guarded(asof.visible(rows, day), day)
    late = rows.where(F.col("available_at") > F.lit(day).cast("date"))
    counted = lambda df, future: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(future).alias("is_future"), "n")
    return counted(seen, False).unionByName(counted(late, True)).where("n > 0")


@query("guarded_statements", """
SELECT c.date AS as_of_date, f.security_id, arg_max(f.event_time, f.available_at) AS event_time, max(f.available_at) AS available_at
FROM t_calendar c JOIN t_fundamentals f ON f.available_at <= c.date GROUP BY 1, 2""")
def _(spark, sf):
    """The last statement of every date; its plan fails if one is from after its date."""
    dates = tb.decision_dates(spark, sf)
    grid = dates.crossJoin(tb.securities(spark, sf).select("security_id"))  # the output's own size
    found = asof.asof_join(grid, tb.fundamentals(spark, sf).withColumn("_time", F.col("available_at")), ["event_time", "available_at"], time="_time")
    return asof.guarded(found.where("available_at IS NOT NULL"), F.col("as_of_date")).select("as_of_date", "security_id", "event_time", "available_at")


@query("latest_statement", """
SELECT security_id, max(event_time) AS event_time, max(available_at) AS available_at,
       round(arg_max(revenue, available_at), 4) AS revenue
FROM t_fundamentals WHERE available_at <= DATE '1998-06-30' GROUP BY 1""")
def _(spark, sf):
    df = asof.latest_as_of(tb.fundamentals(spark, sf), "1998-06-30")
    return rounded(df.select("security_id", "event_time", "available_at", "revenue"), 4)


@query("latest_statement_every_date", """
SELECT c.date AS as_of_date, s.security_id, f.event_time, f.available_at, round(f.net_income, 4) AS net_income
FROM t_calendar c CROSS JOIN t_securities s
ASOF LEFT JOIN t_fundamentals f ON f.security_id = s.security_id AND f.available_at <= c.date""")
def _(spark, sf):
    dates = tb.decision_dates(spark, sf)
    asked = tb.grid(spark, sf).select("security_id", F.col("date").alias("as_of_date"))
    df = asof.asof_join(
        asked, tb.fundamentals(spark, sf), ["event_time", "available_at", "net_income"], dates
    )
    return rounded(df, 4)


@query("shares_and_issuance", """
SELECT as_of_date, security_id, shares_now AS shares_outstanding,
       round(shares_now / CASE WHEN shares_then > 0 THEN shares_then END - 1, 6) AS net_issuance_1y
FROM t_asof""")
def _(spark, sf):
    asked = tb.grid(spark, sf).select("security_id", F.col("date").alias("as_of_date"))
    df = asof.asof_join_many(
        asked, fu.share_sources(tb.shares(spark, sf)), tb.decision_dates(spark, sf)
    )
    return rounded(
        df.select("as_of_date", "security_id", "shares_outstanding", fu.net_issuance().alias("net_issuance_1y"))
    )


@query("estimate_revisions", """
SELECT as_of_date, security_id, estimates_available_at,
       round(eps_now / nullif(eps_30, 0) - 1, 6) AS eps_rev_30d, round(eps_now / nullif(eps_90, 0) - 1, 6) AS eps_rev_90d,
       CASE WHEN estimates_available_at IS NOT NULL THEN
         round(CAST(n_up AS DOUBLE) / nullif(CAST(n_up + n_down AS DOUBLE), 0), 6) END AS revisions_up_ratio
FROM t_asof""")
def _(spark, sf):
    dates, estimates = tb.decision_dates(spark, sf), tb.estimates(spark, sf)
    asked = tb.grid(spark, sf).select("security_id", F.col("date").alias("as_of_date"))
    df = asof.asof_join_many(asked, fu.estimate_sources(estimates), dates)
    counts = fu.window_sums(dates, estimates, ["n_revisions_up", "n_revisions_down"], 30)
    return rounded(fu.revision_ratios(df, counts))


def event_estimates(spark, sf):
    """Daily estimate snapshots per user: mean value, purchases up, errors down."""
    return (
        tb.read(spark, sf, "events")
        .groupBy(F.col("user_id").alias("security_id"), F.to_date("ts").alias("available_at"))
        .agg(
            F.sum(tb.units(F.col("value"), 100)).alias("_v"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("event_type") == "purchase").alias("n_revisions_up"),
            F.count_if(F.col("event_type") == "error").alias("n_revisions_down"),
        )
        .withColumn("fy1_eps_estimate", F.col("_v") / F.lit(100.0) / F.col("_n"))
        .drop("_v", "_n")
    )


@query("event_estimate_revisions", """
WITH e AS (SELECT user_id AS security_id, CAST(ts AS DATE) AS available_at,
                  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / count(*) AS eps,
                  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS up,
                  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS down
           FROM events GROUP BY 1, 2),
q AS (SELECT DISTINCT user_id AS security_id, d.as_of_date
      FROM events, (SELECT DISTINCT CAST(ts AS DATE) AS as_of_date FROM events) d)
SELECT q.as_of_date, q.security_id, a.available_at AS estimates_available_at,
       round(a.eps / nullif(b.eps, 0) - 1, 6) AS eps_rev_30d, round(a.eps / nullif(c.eps, 0) - 1, 6) AS eps_rev_90d,
       CASE WHEN a.available_at IS NOT NULL THEN (SELECT round(CAST(sum(up) AS DOUBLE) / nullif(CAST(sum(up) + sum(down) AS DOUBLE), 0), 6) FROM e
         WHERE e.security_id = q.security_id AND e.available_at <= q.as_of_date AND e.available_at > q.as_of_date - 7) END AS revisions_up_ratio
FROM q ASOF LEFT JOIN e a ON a.security_id = q.security_id AND a.available_at <= q.as_of_date
ASOF LEFT JOIN e b ON b.security_id = q.security_id AND b.available_at <= q.as_of_date - 7
ASOF LEFT JOIN e c ON c.security_id = q.security_id AND c.available_at <= q.as_of_date - 14""")
def _(spark, sf):
    estimates = event_estimates(spark, sf)
    events = tb.read(spark, sf, "events")
    dates = events.select(F.to_date("ts").alias("as_of_date")).distinct()
    first, last = dates.select(F.min("as_of_date")).scalar(), dates.select(F.max("as_of_date")).scalar()
    days = F.explode(F.sequence(first, last)).alias("as_of_date")
    asked = events.select(F.col("user_id").alias("security_id")).distinct().select("security_id", days)
    df = asof.asof_join_many(asked, fu.estimate_sources(estimates, 7, 14), dates)
    counts = fu.window_sums(dates, estimates, ["n_revisions_up", "n_revisions_down"], 7)
    return rounded(fu.revision_ratios(df, counts))


@query("nearest_statement", """
SELECT s.security_id, s.available_at AS end, f.event_time AS matched_end, round(f.revenue, 4) AS revenue
FROM t_shares s LEFT JOIN LATERAL (
  SELECT * FROM t_fundamentals f WHERE f.security_id = s.security_id
    AND abs(date_diff('day', f.available_at, s.available_at)) <= 7
  ORDER BY abs(date_diff('day', f.available_at, s.available_at)), f.available_at LIMIT 1) f ON TRUE""".replace(
    "f.event_time AS matched_end", "f.available_at AS matched_end").replace(" AS end,", ' AS "end",'))
def _(spark, sf):
    base = tb.shares(spark, sf).select("security_id", F.col("available_at").alias("end"))
    facts = tb.fundamentals(spark, sf).select("security_id", F.col("available_at").alias("end"), "revenue")
    return rounded(asof.nearest_join(base, facts, ["security_id"], "end", ["revenue"]), 4)


@query("members_every_date", "SELECT as_of_date, security_id FROM t_member_days")
def _(spark, sf):
    return asof.members_at(tb.decision_dates(spark, sf), membership(spark, sf))


@query("statement_overlap", """
SELECT DISTINCT f.security_id FROM t_fundamentals f JOIN t_members m ON m.security_id = f.security_id
 AND (m.start_date IS NULL OR m.start_date <= f.event_time) AND (m.end_date IS NULL OR m.end_date > f.event_time)""")
def _(spark, sf):
    return asof.overlaps(tb.fundamentals(spark, sf), membership(spark, sf))


def splits(spark, sf):
    """Split-like events: months in which a supplier sold at least 300 units, ratio 2."""
    big = tb.bars(spark, sf).where("volume >= 300")
    return big.select("security_id", "date", F.when(F.col("volume") >= 400, 3.0).otherwise(2.0).alias("ratio"))


@query("split_adjusted_shares", """
SELECT s.security_id, s.available_at, s.shares_outstanding, coalesce(product(b.ratio), 1.0) AS factor
FROM t_shares s LEFT JOIN (SELECT security_id, date, CASE WHEN volume >= 400 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS ratio
                           FROM t_bars WHERE volume >= 300) b
  ON b.security_id = s.security_id AND b.date > s.available_at
GROUP BY 1, 2, 3""")
def _(spark, sf):
    return asof.product_after(
        tb.shares(spark, sf), splits(spark, sf), "security_id", "available_at", "date", "ratio", "factor"
    )


# ---------------------------------------------------------------- series
_PF = ("price", "adv_usd", "volatility_63d", "mom_12_1", "mom_6m", "mom_3m", "ret_1m",
       "volatility_252d", "beta_252d", "high_52w_ratio")


@query("price_features", f"SELECT as_of_date, security_id, price, {rs(*_PF[1:])} FROM t_price_features")
def _(spark, sf):
    df = se.price_features(tb.grid(spark, sf), bars=tb.BARS)
    return rounded(df.select(F.col("date").alias("as_of_date"), "security_id", *_PF), exact=("price",))


@query("equal_weight_returns", f"SELECT date, {r('benchmark_return')} FROM t_benchmark")
def _(spark, sf):
    rets = se.with_returns(tb.prices(spark, sf))
    daily = se.equal_weight_returns(rets)
    return rounded(tb.calendar(spark, sf).select("date").join(daily, "date", "left"))


@query("forward_filled_close", """
SELECT security_id, date, last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM t_grid""")
def _(spark, sf):
    return tb.grid(spark, sf).select("security_id", "date", se.forward_fill("close").alias("close"))


@query("moving_averages", """
SELECT security_id, date,
  CASE WHEN row_number() OVER w >= 3 THEN round(avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS sma_3,
  CASE WHEN row_number() OVER w >= 12 THEN round(avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) END AS sma_12
FROM t_prices WINDOW w AS (PARTITION BY security_id ORDER BY pos)""")
def _(spark, sf):
    return rounded(
        tb.prices(spark, sf).select(
            "security_id", "date",
            se.moving_average("close", 3).alias("sma_3"),
            se.moving_average("close", 12).alias("sma_12"),
        )
    )


@query("equity_and_drawdown", """
WITH e AS (SELECT security_id, date, pos, product(1 + coalesce(ret, 0)) OVER (PARTITION BY security_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM t_returns)
SELECT security_id, date, round(equity, 6) AS equity,
  round(equity / max(equity) OVER w - 1, 6) AS drawdown, round(equity / first_value(equity) OVER w * 100, 5) AS rebased
FROM e WINDOW w AS (PARTITION BY security_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    rets = se.with_returns(tb.grid(spark, sf))
    eq = rets.select("security_id", "date", "pos", se.cumulative_growth("ret", ["security_id"], "pos").alias("equity"))
    return rounded(
        eq.select(
            "security_id", "date", "equity",
            se.drawdown("equity", ["security_id"], "pos").alias("drawdown"),
            se.rebase("equity", ["security_id"], "pos").alias("rebased"),
        ),
        rebased=5,
    )


@query("universe_index", """
WITH d AS (SELECT r.date, r.pos, avg(CASE WHEN m.security_id IS NOT NULL THEN r.ret END) AS ret
  FROM t_returns r LEFT JOIN t_calendar p ON p.pos = r.pos - 1
  LEFT JOIN t_member_days m ON m.as_of_date = p.date AND m.security_id = r.security_id GROUP BY 1, 2)
SELECT date, round(coalesce(ret, 0), 6) AS ret,
  round(product(1 + coalesce(ret, 0)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS level FROM d""")
def _(spark, sf):
    rets = se.with_returns(tb.grid(spark, sf))
    return rounded(se.universe_benchmark(rets, membership(spark, sf)), level=5)


@query("index_alignment", """
WITH i AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0::DOUBLE AS close
           FROM orders WHERE month(o_orderdate) % 3 <> 0 GROUP BY 1)
SELECT c.date, c.pos, round(last_value(i.close IGNORE NULLS) OVER (ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS close
FROM t_calendar c LEFT JOIN i ON i.date = c.date""")
def _(spark, sf):
    # An index that is not published in the last month of a quarter.
    index = (
        tb.read(spark, sf, "orders")
        .where("month(o_orderdate) % 3 <> 0")
        .groupBy(F.last_day("o_orderdate").alias("date"))
        .agg((F.sum(tb.units(F.col("o_totalprice"), 100)) / F.lit(100.0)).alias("close"))
    )
    return rounded(se.align_index(tb.calendar(spark, sf), index), 2)


@query("trailing_returns", """
SELECT d.date AS as_of_date, r.security_id, r.date, round(r.ret, 6) AS ret
FROM t_calendar d JOIN t_returns r ON r.pos > d.pos - 6 AND r.pos <= d.pos AND r.pos > 0""")
def _(spark, sf):
    from quantloom.operators.risk import trailing_returns

    dates = tb.calendar(spark, sf)
    rets = se.with_returns(tb.grid(spark, sf))
    return rounded(trailing_returns(rets, dates, 6))


@query("delisted_names", """
SELECT * FROM (SELECT security_id, max(pos) FILTER (WHERE close IS NOT NULL) AS last_pos,
  arg_max(close, pos) AS last_close, max(pos) FILTER (WHERE close IS NOT NULL) + 6 AS liquidation_pos
  FROM t_prices GROUP BY 1) WHERE last_pos < (SELECT max(pos) FROM t_calendar)""")
def _(spark, sf):
    return se.last_quotes(tb.prices(spark, sf), tb.calendar(spark, sf))


# ---------------------------------------------------------------- statements
_TTM = tuple(f"ttm_{c}" for c in fu.FLOWS)
_STATE_NUMBERS = (*_TTM, "net_debt", "invested_capital", "latest_revenue", "latest_net_income",
                  "prev_revenue", "prev_net_income", "prev_invested_capital")


@query("trailing_twelve_months", f"""
SELECT c.date AS as_of_date, s.security_id, {rs(*_STATE_NUMBERS, digits=4)},
       {rs("gross_margin_volatility", "earnings_volatility", digits=8)}, fundamentals_available_at
FROM t_calendar c CROSS JOIN t_securities s LEFT JOIN t_ttm t ON t.as_of_date = c.date AND t.security_id = s.security_id""")
def _(spark, sf):
    asked = tb.grid(spark, sf).select("security_id", F.col("date").alias("as_of_date"))
    states = fu.filing_states(tb.fundamentals(spark, sf))
    df = asof.asof_join(asked, states, fu.STATE_COLUMNS, tb.decision_dates(spark, sf))
    return rounded(df, 4, gross_margin_volatility=8, earnings_volatility=8)


@query("median_filing_lag", """
SELECT quantile_cont(date_diff('day', event_time, available_at), 0.5)::DOUBLE AS median_days, count(*) AS n FROM t_fundamentals""")
def _(spark, sf):
    # Lags are whole days, so the exact percentile keeps one counter per distinct lag.
    lag = F.datediff("available_at", "event_time")
    return tb.fundamentals(spark, sf).agg(
        F.percentile(lag, 0.5).alias("median_days"), F.count(F.lit(1)).alias("n")
    )


_ALL_FEATURES = (*_PF, "shares_outstanding", "net_issuance_1y", "log_market_cap", "earnings_yield",
                 "fcf_yield", "ev_ebitda", "roic", "gross_margin", "fcf_margin", "net_debt_ebitda", "revenue_growth",
                 "eps_growth", "sales_yield", "gross_profitability", "accruals", "asset_growth", "gross_margin_volatility",
                 "earnings_volatility", "eps_rev_30d", "eps_rev_90d", "revisions_up_ratio")


@query("feature_snapshot", f"""
SELECT as_of_date, security_id, ticker, sector_id, industry_id, in_universe, price, {rs(*_ALL_FEATURES[1:])},
       round(market_cap_usd, 3) AS market_cap_usd, fundamentals_available_at, estimates_available_at,
       'suppliers_monthly' AS data_version
FROM t_features""")
def _(spark, sf):
    return rounded(snapshot(spark, sf), exact=("price",), market_cap_usd=3)


@query("snapshot_for_one_date", f"""
SELECT security_id, price, {rs("mom_12_1", "earnings_yield", "beta_252d")} FROM t_features WHERE as_of_date = DATE '1999-12-31'""")
def _(spark, sf):
    day = snapshot(spark, sf).where("as_of_date = DATE '1999-12-31'")
    return rounded(day.select("security_id", "price", "mom_12_1", "earnings_yield", "beta_252d"), exact=("price",))


# ---------------------------------------------------------------- cross-section
@query("average_rank_percentile", f"""
SELECT as_of_date, security_id, round({percentile_of("adv_usd", "as_of_date")}, 9) AS pct FROM t_price_features""")
def _(spark, sf):
    df = se.price_features(tb.grid(spark, sf), bars=tb.BARS).select(
        F.col("date").alias("as_of_date"), "security_id", "adv_usd"
    )
    out = rk.with_percentiles(df, ["as_of_date"], ["as_of_date", "security_id"], {"pct": "adv_usd"})
    return rounded(out.select("as_of_date", "security_id", "pct"), 9)


@query("tied_rank_percentile", f"""
SELECT l_shipdate_day AS day, l_quantity, n, round((r + (k - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n, 9) AS pct
FROM (SELECT l_shipdate_day, l_quantity, any_value(k) AS k, any_value(n) AS n, any_value(r) AS r FROM
  (SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS l_shipdate_day, l_quantity,
     rank() OVER (PARTITION BY date_trunc('year', l_shipdate) ORDER BY l_quantity) AS r,
     count(*) OVER (PARTITION BY date_trunc('year', l_shipdate), l_quantity) AS k,
     count(*) OVER (PARTITION BY date_trunc('year', l_shipdate)) AS n FROM lineitem) GROUP BY 1, 2)""")
def _(spark, sf):
    # Whole years of line items share 50 quantities: heavy ties in few, large groups.
    lines = tb.read(spark, sf, "lineitem").select(
        F.trunc(F.to_date("l_shipdate"), "year").alias("day"), "l_quantity"
    )
    ranked = rk.rank_values(lines, ["day"], "l_quantity")
    pct = ((rk.mid_rank() - 0.5) / F.col("n_total")).alias("pct")
    return rounded(ranked.select("day", "l_quantity", F.col("n_total").alias("n"), pct), 9)


@query("universe_quantiles", """
SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS day, count(*) AS n,
  round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    lines = tb.read(spark, sf, "lineitem").select(
        F.trunc(F.to_date("l_shipdate"), "year").alias("day"), "l_extendedprice"
    )
    q = rk.group_quantiles(lines, ["day"], "l_extendedprice", {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return rounded(q.withColumnRenamed("n_total", "n"))


@query("momentum_sector_percentile", percentile_sql("t_price_named", {"mom_6m": True}).replace(
    "SELECT as_of_date, security_id, factor,", "SELECT as_of_date, security_id, factor, round(", 1).replace(
    "END AS pct", "END, 9) AS pct", 1))
def _(spark, sf):
    df = se.price_features(tb.grid(spark, sf), bars=tb.BARS).select(
        F.col("date").alias("as_of_date"), "security_id", "mom_6m"
    )
    named = df.join(tb.securities(spark, sf).select("security_id", "sector_id"), "security_id")
    return rounded(cs.feature_percentiles(named, {"mom_6m": True}), 9)


@query("equal_count_buckets", """
WITH f AS (SELECT as_of_date, security_id, mom_6m, row_number() OVER w AS rank, count(*) OVER (PARTITION BY as_of_date) AS n
           FROM t_price_features WHERE mom_6m IS NOT NULL WINDOW w AS (PARTITION BY as_of_date ORDER BY mom_6m, security_id))
SELECT as_of_date, security_id, rank, n, CAST(CASE WHEN n > 1 THEN greatest(ceil((rank - 1) * 5.0::DOUBLE / (n - 1)) - 1, 0) ELSE 0 END AS BIGINT) AS bucket
FROM f""")
def _(spark, sf):
    df = se.price_features(tb.grid(spark, sf), bars=tb.BARS).select(
        F.col("date").alias("as_of_date"), "security_id", "mom_6m"
    )
    out = rk.first_rank(df, ["as_of_date"], "mom_6m", "security_id", "rank")
    bucket = rk.equal_count_bucket(F.col("rank"), F.col("rank_n")).alias("bucket")
    return rounded(out.select("as_of_date", "security_id", "rank", F.col("rank_n").alias("n"), bucket))


@query("eligibility_screen", """
SELECT as_of_date, security_id, reasons = '' AS eligible, reasons AS ineligibility_reasons FROM t_screened""")
def _(spark, sf):
    df = cs.with_eligibility(snapshot(spark, sf), tb.STRATEGY.eligibility)
    return df.select(
        "as_of_date", "security_id", "eligible",
        F.array_join("ineligibility_reasons", ",").alias("ineligibility_reasons"),
    )


@query("feature_percentiles", "SELECT as_of_date, security_id, factor, round(pct, 9) AS pct FROM t_pct")
def _(spark, sf):
    return rounded(eligible_percentiles(spark, sf), 9)


_SCORES = (*[f"{f}_score" for f in FAMILIES], "data_coverage", "composite_score")
_PERCENTILES = (*[f"{f}_percentile" for f in FAMILIES], "composite_percentile", "liquidity_percentile")


@query("factor_scores", f"SELECT as_of_date, security_id, {rs(*_SCORES)} FROM t_composite")
def _(spark, sf):
    eligible = cs.with_eligibility(snapshot(spark, sf), tb.STRATEGY.eligibility).where("eligible")
    df = cs.factor_scores(eligible, tb.STRATEGY)
    return rounded(df.select("as_of_date", "security_id", *_SCORES))


@query("scored_universe", f"""
SELECT as_of_date, security_id, risk_flag::BIGINT AS risk_flag, {rs("composite_score", *_PERCENTILES, digits=9)} FROM t_scored""")
def _(spark, sf):
    return rounded(
        scored(spark, sf).select("as_of_date", "security_id", "risk_flag", "composite_score", *_PERCENTILES), 9
    )


@query("ranked_signals", """
SELECT as_of_date, security_id, ticker, sector_id, decision, round(composite_score, 6) AS composite_score,
  row_number() OVER (PARTITION BY as_of_date ORDER BY composite_score DESC, security_id) AS rank FROM t_signals""")
def _(spark, sf):
    df = signals(spark, sf).withColumn("_key", -F.col("composite_score"))
    ranked = rk.first_rank(df, ["as_of_date"], "_key", "security_id", "rank")
    return rounded(
        ranked.select("as_of_date", "security_id", "ticker", "sector_id", "decision", "composite_score", "rank")
    )


@query("decision_counts", """
SELECT d.as_of_date, x.decision, count(s.security_id) AS n
FROM (SELECT DISTINCT as_of_date FROM t_signals) d
CROSS JOIN (VALUES ('STRONG_LONG'), ('LONG'), ('WATCH'), ('NEUTRAL'), ('REDUCE'), ('AVOID')) x(decision)
LEFT JOIN t_signals s ON s.as_of_date = d.as_of_date AND s.decision = x.decision GROUP BY 1, 2""")
def _(spark, sf):
    from quantloom.operators.views import decision_counts

    return decision_counts(signals(spark, sf))


def _explain_sql() -> str:
    from quantloom.operators.crosssection import FAMILY_LABELS

    def pct(x: str) -> str:
        return f"CAST(round_even({x} * 100.0::DOUBLE, 0) AS INTEGER)"

    lines = [
        f"CASE WHEN composite_percentile >= 0.5 THEN 'Top ' || greatest(1, {pct('(1.0::DOUBLE - composite_percentile)')}) || '% del universo elegible' "
        f"ELSE 'Bottom ' || greatest(1, {pct('composite_percentile')}) || '% del universo elegible' END"
    ]
    for f in FAMILIES:
        lab = FAMILY_LABELS[f]
        lines.append(
            f"CASE WHEN {f}_percentile IS NULL THEN 'Sin datos suficientes de {lab}' "
            f"WHEN {f}_percentile >= 0.80 THEN 'Fuerte en {lab} (percentil ' || {pct(f + '_percentile')} || '%)' "
            f"WHEN {f}_percentile <= 0.20 THEN 'Débil en {lab} (percentil ' || {pct(f + '_percentile')} || '%)' END"
        )
    lines.append("CASE WHEN risk_flag = 1 THEN 'Volatilidad realizada en el 5% más alto del universo' END")
    return ", ".join(lines)


@query("signal_explanations", f"""
SELECT as_of_date, security_id, concat_ws('; ', {_explain_sql()}) AS explanation FROM t_scored""")
def _(spark, sf):
    return scored(spark, sf).select(
        "as_of_date", "security_id", F.array_join("explanation", "; ").alias("explanation")
    )
