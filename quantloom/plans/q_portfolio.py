"""Risk, portfolio and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import performance as pf, portfolio as po, research as rs, risk as rk
from quantloom.operators import series as se
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans.oracle import block
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.registry import query, rounded, staged

LIMITS = tb.STRATEGY.risk
KEYS = ["portfolio_id", "as_of_date"]
LOOKBACK = LIMITS.lookback_days

block("t_share_weights", """
SELECT s.sector_id AS portfolio_id, date AS as_of_date, security_id, s.sector_id, s.industry_id,
       CAST(u AS DOUBLE) / CAST(sum(u) OVER (PARTITION BY s.sector_id, date) AS DOUBLE) AS weight
FROM (SELECT security_id, date, sum(CAST(round(net * 10000) AS BIGINT)) AS u FROM t_lines GROUP BY 1, 2) l
JOIN t_securities s USING (security_id)
""")


def risk_blocks(t: str, weights: str) -> None:
    """Blocks of the risk model of one weights table, their names beginning with ``t``."""
    block(f"{t}risk_weights", f"SELECT * FROM {weights}")
    block(f"{t}window", f"""
SELECT w.portfolio_id, w.as_of_date, w.security_id, w.weight, r.date, coalesce(r.ret, 0) AS ret, r.ret IS NOT NULL AS known
FROM {t}risk_weights w JOIN t_calendar c ON c.date = w.as_of_date
JOIN t_returns r ON r.security_id = w.security_id AND r.pos > c.pos - {LOOKBACK} AND r.pos <= c.pos AND r.pos > 0
""")
    block(f"{t}names", f"""
SELECT portfolio_id, as_of_date, security_id, any_value(weight) AS weight, avg(CASE WHEN known THEN 1.0::DOUBLE ELSE 0 END) >= 0.6 AS good,
       avg(ret) AS m, count(*) AS n FROM {t}window GROUP BY 1, 2, 3
""")
    block(f"{t}x", f"SELECT w.*, w.ret - n.m AS x, n.n FROM {t}window w JOIN {t}names n USING (portfolio_id, as_of_date, security_id) WHERE n.good")
    block(f"{t}sample", f"""
SELECT a.portfolio_id, a.as_of_date, a.security_id AS i, b.security_id AS j, sum(a.x * b.x) / any_value(a.n) AS s
FROM {t}x a JOIN {t}x b ON a.portfolio_id = b.portfolio_id AND a.as_of_date = b.as_of_date AND a.date = b.date GROUP BY 1, 2, 3, 4
""")
    block(f"{t}lw", f"""
SELECT portfolio_id, as_of_date, mu, p, n, CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 0 END AS shrink FROM (
 SELECT s.portfolio_id, s.as_of_date, s.mu, s.p, q.n, (s.f2 - s.p * s.mu * s.mu) / s.p AS d2, (q.x4 - q.n * s.f2) / (q.n * q.n * s.p) AS b2
 FROM (SELECT portfolio_id, as_of_date, sum(s) FILTER (WHERE i = j) / count(*) FILTER (WHERE i = j) AS mu, count(*) FILTER (WHERE i = j)::DOUBLE AS p, sum(s * s) AS f2
       FROM {t}sample GROUP BY 1, 2) s
 JOIN (SELECT portfolio_id, as_of_date, sum(v * v) AS x4, count(*)::DOUBLE AS n FROM (SELECT portfolio_id, as_of_date, date, sum(x * x) AS v FROM {t}x GROUP BY 1, 2, 3) GROUP BY 1, 2) q
 USING (portfolio_id, as_of_date))
""")
    block(f"{t}cov", f"""
SELECT s.portfolio_id, s.as_of_date, s.i, s.j, 12 * ((1 - l.shrink) * s.s + CASE WHEN i = j THEN l.shrink * l.mu ELSE 0 END) AS c
FROM {t}sample s JOIN {t}lw l USING (portfolio_id, as_of_date)
""")
    block(f"{t}sigma_w", f"""
SELECT n.portfolio_id, n.as_of_date, n.security_id, n.weight,
  CASE WHEN n.good THEN (SELECT sum(c.c * m.weight) FROM {t}cov c JOIN {t}names m ON m.portfolio_id = c.portfolio_id AND m.as_of_date = c.as_of_date AND m.security_id = c.j
                         WHERE c.portfolio_id = n.portfolio_id AND c.as_of_date = n.as_of_date AND c.i = n.security_id)
       ELSE n.weight * (SELECT quantile_cont(c.c, 0.5) FROM {t}cov c WHERE c.i = c.j AND c.portfolio_id = n.portfolio_id AND c.as_of_date = n.as_of_date) END AS sw
FROM {t}names n
""")
    block(f"{t}variance", f"SELECT portfolio_id, as_of_date, sum(weight * sw) AS variance, sum(weight) AS gross_exposure, sum(weight * weight) AS herfindahl FROM {t}sigma_w GROUP BY 1, 2")
    block(f"{t}contrib", f"SELECT s.portfolio_id, s.as_of_date, s.security_id, s.weight, CASE WHEN variance > 0 THEN weight * sw / variance ELSE 0 END AS risk_contribution FROM {t}sigma_w s JOIN {t}variance v USING (portfolio_id, as_of_date)")


risk_blocks("t_", "t_share_weights")
block("t_hist", """
SELECT h.*, b.benchmark_return FROM (SELECT portfolio_id, as_of_date, date, sum(ret * weight) AS hist FROM t_window GROUP BY 1, 2, 3) h
LEFT JOIN t_benchmark b USING (date)
""")
block("t_report", f"""
SELECT v.portfolio_id, v.as_of_date, v.gross_exposure, v.herfindahl, sqrt(greatest(variance, 0)) AS volatility_annual,
  sqrt(greatest(variance, 0)) / sqrt(12) * {rk.Z_95!r}::DOUBLE AS var_95_daily, sqrt(greatest(variance, 0)) / sqrt(12) * {rk.ES_95!r}::DOUBLE AS cvar_95_daily,
  h.historical_var_95_daily, h.historical_cvar_95_daily, h.beta
FROM t_variance v JOIN (
  SELECT portfolio_id, as_of_date, CASE WHEN count(*) > 20 THEN -any_value(cut) END AS historical_var_95_daily,
    -avg(hist) FILTER (WHERE hist <= cut) AS historical_cvar_95_daily,
    CASE WHEN count(benchmark_return) > 20 THEN covar_samp(hist, benchmark_return) / var_samp(benchmark_return) END AS beta
  FROM t_hist JOIN (SELECT portfolio_id, as_of_date, quantile_cont(hist, 0.05) AS cut FROM t_hist GROUP BY 1, 2) USING (portfolio_id, as_of_date) GROUP BY 1, 2) h
USING (portfolio_id, as_of_date)
""")


def share_weights(spark, sf):
    """A portfolio per region: month's share of net revenue of each of its suppliers."""

    def build():
        units = tb.monthly(spark, sf).select("security_id", "date", F.col("revenue").alias("_u"))
        named = units.join(tb.securities(spark, sf).drop("ticker"), "security_id")
        total = named.groupBy("sector_id", "date").agg(F.sum("_u").alias("_t"))
        return named.join(total, ["sector_id", "date"]).select(
            F.col("sector_id").alias("portfolio_id"), F.col("date").alias("as_of_date"), "security_id",
            "sector_id", "industry_id", (F.col("_u") / F.col("_t").cast("double")).alias("weight"),
        )

    return staged(spark, sf, "share_weights", build)


def risk_window(spark, sf, weights):
    """Trailing returns of the held names, per portfolio and date."""
    held = weights.select("portfolio_id", "as_of_date", "security_id")
    return rk.held_returns(pl.returns(spark, sf), held, tb.calendar(spark, sf), LOOKBACK)


def risk_index(spark, sf, window):
    """The benchmark on the days of each window."""
    bench = se.equal_weight_returns(pl.returns(spark, sf))
    return window.select("portfolio_id", "as_of_date", "date").distinct().join(F.broadcast(bench), "date", "left")


def risk_inputs(spark, sf, weights):
    window = risk_window(spark, sf, weights)
    return window, risk_index(spark, sf, window)


def share_names(spark, sf):
    """The look-back of each holding of the regional portfolios, packed, with its moments."""

    def build():
        held = share_weights(spark, sf).select(*KEYS, "security_id", "weight")
        return rk.name_moments(rk.held_windows(pl.returns(spark, sf), held, tb.calendar(spark, sf), LOOKBACK))

    return staged(spark, sf, "risk_names", build)


def share_scalars(spark, sf):
    named = share_names(spark, sf)
    return staged(spark, sf, "risk_scalars", lambda: rk.shrinkage(named, rk.window_sums(named, KEYS), KEYS))


def risk_tables(spark, sf):
    sigma = lambda df: staged(spark, sf, "risk_sigma", lambda: df)
    bench = se.equal_weight_returns(pl.returns(spark, sf))
    report, contributions = rk.windows_report(
        share_names(spark, sf), share_scalars(spark, sf), bench, KEYS, periods=12, materialize=sigma)
    return share_weights(spark, sf), staged(spark, sf, "risk_report", lambda: report), contributions


_REPORT = ("gross_exposure", "herfindahl", "volatility_annual", "var_95_daily", "cvar_95_daily",
           "historical_var_95_daily", "historical_cvar_95_daily", "beta")


@query("portfolio_weights", "SELECT portfolio_id, as_of_date, security_id, round(weight, 9) AS weight FROM t_share_weights")
def _(spark, sf):
    return rounded(share_weights(spark, sf).select(*KEYS, "security_id", "weight"), 9)


@query("portfolio_risk_report", f"SELECT portfolio_id, as_of_date, {rnd(*_REPORT)} FROM t_report")
def _(spark, sf):
    return rounded(risk_tables(spark, sf)[1])


@query("risk_contributions", "SELECT portfolio_id, as_of_date, security_id, round(weight, 9) AS weight, round(risk_contribution, 6) AS risk_contribution FROM t_contrib")
def _(spark, sf):
    return rounded(risk_tables(spark, sf)[2], 6, weight=9)


@query("covariance_shrinkage", "SELECT portfolio_id, as_of_date, n::BIGINT AS n, p::BIGINT AS p, round(mu, 6) AS mu, round(shrink, 6) AS shrink FROM t_lw")
def _(spark, sf):
    return rounded(share_scalars(spark, sf).select(*KEYS, "n", "p", "mu", "shrink"))


@query("top_risk_contributors", """
SELECT portfolio_id, as_of_date, security_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, as_of_date ORDER BY risk_contribution DESC, security_id) AS rank FROM t_contrib) WHERE rank <= 5""")
def _(spark, sf):
    top = rk.top_contributors(risk_tables(spark, sf)[2], KEYS)
    return rounded(top.select(*KEYS, "security_id", "rank"))


@query("industry_exposure", "SELECT portfolio_id, as_of_date, industry_id, round(sum(weight), 6) AS exposure FROM t_share_weights GROUP BY 1, 2, 3")
def _(spark, sf):
    w = share_weights(spark, sf).drop("industry_id")
    return rounded(rk.group_exposure(w, tb.securities(spark, sf), KEYS, "industry_id"))


block("t_breaches", f"""
SELECT portfolio_id, as_of_date, 'PORTFOLIO_VOLATILITY' AS code, 'CRITICAL' AS severity, volatility_annual AS value, {LIMITS.max_portfolio_volatility}::DOUBLE AS lim, NULL::VARCHAR AS subject
  FROM t_report WHERE volatility_annual > {LIMITS.max_portfolio_volatility} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'VAR_95', 'CRITICAL', var_95_daily, {LIMITS.max_var_95_daily}, NULL FROM t_report WHERE var_95_daily > {LIMITS.max_var_95_daily} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'BETA', 'WARNING', beta, {LIMITS.max_beta}, NULL FROM t_report WHERE beta > {LIMITS.max_beta} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'SECTOR_CONCENTRATION', 'WARNING', sum(weight), 0.25, sector_id FROM t_risk_weights GROUP BY 1, 2, sector_id HAVING sum(weight) > 0.25 + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'INDUSTRY_CONCENTRATION', 'WARNING', sum(weight), {LIMITS.max_industry_weight}, industry_id FROM t_risk_weights GROUP BY 1, 2, industry_id HAVING sum(weight) > {LIMITS.max_industry_weight} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'RISK_CONTRIBUTION', 'WARNING', risk_contribution, {LIMITS.max_single_name_risk_contribution}, CAST(security_id AS VARCHAR) FROM t_contrib WHERE risk_contribution > {LIMITS.max_single_name_risk_contribution} + 1e-6
""")


def breaches(spark, sf):
    weights, report, contributions = risk_tables(spark, sf)
    bare, secs = weights.drop("sector_id", "industry_id"), tb.securities(spark, sf)
    return rk.limit_breaches(
        report, rk.group_exposure(bare, secs, KEYS, "sector_id"), rk.group_exposure(bare, secs, KEYS, "industry_id"),
        contributions, KEYS, LIMITS, 0.25,
    )


@query("limit_breaches", 'SELECT portfolio_id, as_of_date, code, severity, round(value, 5) AS value, lim AS "limit", subject FROM t_breaches')
def _(spark, sf):
    return rounded(breaches(spark, sf), 5)


# ---------------------------------------------------------------- alerts
block("t_pairs", "SELECT c.date AS as_of_date, p.date AS prev_date FROM t_calendar c JOIN t_calendar p ON p.pos = c.pos - 1")
block("t_held", "SELECT n.as_of_date, s.security_id FROM t_signals s JOIN t_pairs n ON n.prev_date = s.as_of_date WHERE s.composite_percentile >= 0.6")
block("t_alerts", """
SELECT h.as_of_date, h.security_id, a.severity, a.code FROM t_held h
LEFT JOIN t_signals c ON c.as_of_date = h.as_of_date AND c.security_id = h.security_id
LEFT JOIN t_pairs n ON n.as_of_date = h.as_of_date LEFT JOIN t_signals p ON p.as_of_date = n.prev_date AND p.security_id = h.security_id
JOIN (VALUES ('WARNING', 'HOLDING_LEFT_UNIVERSE'), ('WARNING', 'HOLDING_DOWNGRADED'), ('INFO', 'SCORE_DROP')) a(severity, code) ON
  (a.code = 'HOLDING_LEFT_UNIVERSE' AND c.decision IS NULL)
  OR (a.code = 'HOLDING_DOWNGRADED' AND c.decision IN ('REDUCE', 'AVOID') AND coalesce(p.decision, '') NOT IN ('REDUCE', 'AVOID'))
  OR (a.code = 'SCORE_DROP' AND p.composite_score - c.composite_score >= 15)
UNION ALL
SELECT c.as_of_date, c.security_id, 'INFO', 'NEW_STRONG_LONG' FROM t_signals c JOIN t_pairs n USING (as_of_date)
LEFT JOIN t_signals p ON p.as_of_date = n.prev_date AND p.security_id = c.security_id
WHERE c.decision = 'STRONG_LONG' AND coalesce(p.decision, '') <> 'STRONG_LONG'
  AND NOT EXISTS (SELECT 1 FROM t_held h WHERE h.as_of_date = c.as_of_date AND h.security_id = c.security_id)
""")


def shifted(spark, sf, df, bars=1):
    """Rows moved to the decision date ``bars`` trading dates later."""
    days = tb.calendar(spark, sf)
    now = days.select(F.col("date").alias("_now"), (F.col("pos") - bars).alias("pos"))
    pairs = days.join(now, "pos").select(F.col("date").alias("as_of_date"), "_now")
    return df.join(F.broadcast(pairs), "as_of_date").drop("as_of_date").withColumnRenamed("_now", "as_of_date")


def signal_alerts(spark, sf):
    signals = pl.signals(spark, sf).select("as_of_date", "security_id", "decision", "composite_score", "composite_percentile")
    previous = shifted(spark, sf, signals)
    held = previous.where("composite_percentile >= 0.6").select("as_of_date", "security_id")
    first = tb.calendar(spark, sf).select(F.min("date")).scalar()
    return rk.signal_alerts(previous, signals.where(F.col("as_of_date") > first), held, ["as_of_date"])


@query("signal_alerts", "SELECT as_of_date, security_id, severity, code FROM t_alerts")
def _(spark, sf):
    return signal_alerts(spark, sf)


@query("combined_alerts", """
WITH b AS (SELECT as_of_date, severity, code FROM t_breaches)
SELECT as_of_date, severity, code FROM b UNION ALL
SELECT a.as_of_date, a.severity, a.code FROM t_alerts a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.as_of_date = a.as_of_date AND b.code = a.code)""")
def _(spark, sf):
    return rk.alerts_not_reported(signal_alerts(spark, sf), breaches(spark, sf), ["as_of_date"])


block("t_equity", "SELECT security_id, pos, product(1 + coalesce(ret, 0)) OVER (PARTITION BY security_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM t_returns")


@query("drawdown_alerts", """
SELECT security_id, CASE WHEN dd <= -0.2 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'DRAWDOWN' AS code, round(dd, 6) AS drawdown
FROM (SELECT security_id, arg_max(equity, pos) / max(equity) - 1 AS dd FROM t_equity GROUP BY 1) WHERE dd <= -0.1""")
def _(spark, sf):
    rets = pl.returns(spark, sf)
    eq = rets.select("security_id", "pos", se.cumulative_growth("ret", ["security_id"], "pos").alias("equity"))
    return rounded(rk.drawdown_alerts(eq, ["security_id"], "pos"))


# ---------------------------------------------------------------- selection and weights
SIZING = tb.STRATEGY.portfolio
block("t_chosen", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY cls, composite_score DESC, security_id) AS r FROM (
  SELECT s.*, CASE WHEN h.security_id IS NOT NULL AND decision NOT IN ('REDUCE', 'AVOID') THEN 0 WHEN decision IN ('STRONG_LONG', 'LONG') THEN 1
    WHEN decision = 'WATCH' THEN 2 WHEN decision = 'NEUTRAL' THEN 3 END AS cls
  FROM t_signals s LEFT JOIN t_held h ON h.as_of_date = s.as_of_date AND h.security_id = s.security_id) WHERE cls IS NOT NULL)
WHERE (cls <= 1 AND r <= {SIZING.max_holdings}) OR (cls >= 2 AND r <= {SIZING.min_holdings})
""")
block("t_raw_weights", """
SELECT as_of_date, security_id, sector_id, industry_id, raw / sum(raw) OVER (PARTITION BY as_of_date) AS weight, 1.0::DOUBLE / count(*) OVER (PARTITION BY as_of_date) AS equal_weight
FROM (SELECT c.*, 1 / greatest(coalesce(volatility_63d, med, 1), 0.05) AS raw FROM t_chosen c
      JOIN (SELECT as_of_date, quantile_cont(volatility_63d, 0.5) AS med FROM t_chosen GROUP BY 1) USING (as_of_date))
""")
PASSES = 60
block("t_cap_0", "SELECT as_of_date, security_id, sector_id, weight AS base, weight AS w FROM t_raw_weights")
for _i in range(PASSES):
    block(f"t_cap_{_i + 1}", f"""
SELECT as_of_date, security_id, sector_id, base, w + CASE WHEN deficit > 1e-10 AND room THEN coalesce(deficit * base / sum(CASE WHEN room THEN base END) OVER (PARTITION BY as_of_date), 0) ELSE 0 END AS w
FROM (SELECT *, 1 - sum(w) OVER (PARTITION BY as_of_date) AS deficit,
        ({SIZING.max_position_weight} - w) > 1e-10 AND greatest({SIZING.max_sector_weight} - sum(w) OVER (PARTITION BY as_of_date, sector_id), 0) > 1e-10 AS room
      FROM (SELECT as_of_date, security_id, sector_id, base, c * least({SIZING.max_sector_weight} / sum(c) OVER (PARTITION BY as_of_date, sector_id), 1) AS w
            FROM (SELECT *, least(w, {SIZING.max_position_weight}) AS c FROM t_cap_{_i})))""")
block("t_target", f"SELECT as_of_date, security_id, w AS weight FROM t_cap_{PASSES} WHERE w > 0")


def held_before(spark, sf):
    previous = shifted(spark, sf, pl.signals(spark, sf).select("as_of_date", "security_id", "composite_percentile"))
    return previous.where("composite_percentile >= 0.6").select("as_of_date", "security_id")


def chosen(spark, sf):
    return po.select_holdings(pl.signals(spark, sf), held_before(spark, sf), ["as_of_date"], SIZING)


def target(spark, sf):
    return staged(spark, sf, "target", lambda: po.target_weights(
        pl.signals(spark, sf), held_before(spark, sf), ["as_of_date"], SIZING))


@query("selected_holdings", "SELECT as_of_date, security_id, decision FROM t_chosen")
def _(spark, sf):
    return chosen(spark, sf).select("as_of_date", "security_id", "decision")


@query("equal_weights", "SELECT as_of_date, security_id, round(equal_weight, 9) AS weight FROM t_raw_weights")
def _(spark, sf):
    return rounded(po.equal_weight(chosen(spark, sf), ["as_of_date"]).select("as_of_date", "security_id", "weight"), 9)


@query("inverse_volatility_weights", "SELECT as_of_date, security_id, round(weight, 9) AS weight FROM t_raw_weights")
def _(spark, sf):
    return rounded(po.inverse_volatility(chosen(spark, sf), ["as_of_date"]).select("as_of_date", "security_id", "weight"), 9)


@query("capped_target_weights", "SELECT as_of_date, security_id, round(weight, 6) AS weight FROM t_target")
def _(spark, sf):
    return rounded(target(spark, sf).select("as_of_date", "security_id", "weight"))


@query("weight_cap_limits", """
SELECT as_of_date, round(max(weight), 6) AS largest, round(sum(weight), 6) AS invested, round(sum(weight * weight), 6) AS herfindahl, count(*) AS n FROM t_target GROUP BY 1""")
def _(spark, sf):
    return rounded(target(spark, sf).groupBy("as_of_date").agg(
        F.max("weight").alias("largest"), F.sum("weight").alias("invested"),
        F.sum(F.col("weight") * F.col("weight")).alias("herfindahl"), F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- rebalance
BAND, MAX_TURNOVER = 0.005, 0.25
block("t_orders_base", f"""
SELECT *, (tgt <= 0 AND cur > 0) AS is_exit, (cur <= 0 AND tgt > 0) AS is_entry,
   abs(tgt - cur) > {BAND} OR (tgt <= 0 AND cur > 0) OR (cur <= 0 AND tgt > 0) AS trades
FROM (SELECT coalesce(c.portfolio_id, t.portfolio_id) AS portfolio_id, coalesce(c.as_of_date, t.as_of_date) AS as_of_date,
   coalesce(c.security_id, t.security_id) AS security_id, coalesce(c.weight, 0) AS cur, coalesce(t.weight, 0) AS tgt
 FROM (SELECT n.as_of_date, w.portfolio_id, w.security_id, w.weight FROM t_share_weights w JOIN t_pairs n ON n.prev_date = w.as_of_date) c
 FULL JOIN (SELECT * FROM t_share_weights) t ON c.portfolio_id = t.portfolio_id AND c.as_of_date = t.as_of_date AND c.security_id = t.security_id)
""")
block("t_orders_k", f"""
SELECT *, CASE WHEN trades THEN tgt - cur ELSE 0 END AS want, sum(abs(cur)) OVER p <> 0 AND sum(CASE WHEN trades THEN abs(tgt - cur) ELSE 0 END) OVER p > {MAX_TURNOVER} AS capped,
  sum(CASE WHEN is_exit THEN abs(tgt - cur) ELSE 0 END) OVER p AS xt, sum(CASE WHEN trades AND NOT is_exit THEN abs(tgt - cur) ELSE 0 END) OVER p AS rt,
  sum(cur + CASE WHEN trades THEN tgt - cur ELSE 0 END) OVER p AS intended
FROM t_orders_base WINDOW p AS (PARTITION BY portfolio_id, as_of_date)
""")
block("t_orders", f"""
SELECT portfolio_id, as_of_date, security_id, cur, tgt, trades, is_exit, is_entry, capped,
  CASE WHEN capped THEN fin + CASE WHEN intended - sum(fin) OVER p > 1e-12 AND sum(gap) OVER p > 0 THEN gap * least((intended - sum(fin) OVER p) / sum(gap) OVER p, 1) ELSE 0 END - cur ELSE want END AS delta
FROM (SELECT *, CASE WHEN NOT is_exit AND tgt > 0 THEN greatest(tgt - fin, 0) ELSE 0 END AS gap FROM (
  SELECT *, cur + CASE WHEN is_exit THEN want ELSE want * CASE WHEN rt - xt > 0 THEN least(greatest(({MAX_TURNOVER} - 2 * xt) / (rt - xt), 0), 1) ELSE 0 END END AS fin FROM t_orders_k))
WINDOW p AS (PARTITION BY portfolio_id, as_of_date)
""")


def current_weights(spark, sf):
    return shifted(spark, sf, share_weights(spark, sf))


def orders(spark, sf):
    return staged(spark, sf, "orders", lambda: po.plan_rebalance(
        current_weights(spark, sf), share_weights(spark, sf), KEYS, BAND, MAX_TURNOVER))


@query("current_versus_target", "SELECT portfolio_id, as_of_date, security_id, round(cur, 9) AS current_weight, round(tgt, 9) AS target_weight FROM t_orders_base")
def _(spark, sf):
    return rounded(orders(spark, sf).select(*KEYS, "security_id", "current_weight", "target_weight"), 9)


@query("rebalance_orders", """
SELECT portfolio_id, as_of_date, security_id, round(delta, 6) AS delta_weight, round(greatest(cur + delta, 0), 6) AS final_weight,
  CASE WHEN is_entry THEN 'NEW_POSITION' WHEN is_exit THEN 'EXIT_POSITION' WHEN trades AND tgt > cur THEN 'INCREASE_TO_TARGET' WHEN trades AND tgt < cur THEN 'DECREASE_TO_TARGET'
       WHEN NOT trades AND tgt <> cur THEN 'WITHIN_TRADE_BAND' ELSE '' END AS reason, capped AS turnover_capped
FROM t_orders""")
def _(spark, sf):
    return rounded(orders(spark, sf).select(*KEYS, "security_id", "delta_weight", "final_weight", "reason", "turnover_capped"))


@query("rebalance_summary", "SELECT portfolio_id, as_of_date, round(sum(abs(delta)), 6) AS turnover, bool_or(capped) AS turnover_capped, round(sum(greatest(cur + delta, 0)), 6) AS invested FROM t_orders GROUP BY 1, 2")
def _(spark, sf):
    return rounded(po.plan_summary(orders(spark, sf), KEYS).drop("n_orders"))


@query("order_costs", """
SELECT portfolio_id, as_of_date, round(sum(abs(delta * 1000000)) * 1 / 10000, 4) AS commission_cost, round(sum(abs(delta * 1000000)) * 2 / 10000, 4) AS bid_ask_spread_cost,
  round(sum(abs(delta * 1000000)) * 5 / 10000, 4) AS slippage_cost, round(sum(abs(delta * 1000000)) * 8 / 10000, 4) AS estimated_cost_usd FROM t_orders GROUP BY 1, 2""")
def _(spark, sf):
    priced = po.order_costs(orders(spark, sf), F.lit(1_000_000.0), 1.0, 2.0, 5.0)
    costs = ("commission_cost", "bid_ask_spread_cost", "slippage_cost", "estimated_cost_usd")
    return rounded(priced.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in costs]), 4)


@query("unfilled_orders", """
SELECT o.portfolio_id, o.as_of_date, o.security_id, c.pos + 1 AS pos FROM t_orders o JOIN t_calendar c ON c.date = o.as_of_date
LEFT JOIN t_grid g ON g.security_id = o.security_id AND g.pos = c.pos + 1 WHERE o.delta <> 0 AND g.open IS NULL""")
def _(spark, sf):
    missed = po.unfilled_orders(orders(spark, sf), tb.grid(spark, sf), tb.calendar(spark, sf))
    return missed.select(*KEYS, "security_id", "pos")


# ---------------------------------------------------------------- attribution and performance
block("t_periods", "SELECT c.date AS as_of_date, c.pos + 1 AS entry_pos, least(c.pos + 4, (SELECT max(pos) + 1 FROM t_calendar)) AS exit_pos FROM t_calendar c WHERE c.pos % 3 = 0 AND c.pos < (SELECT max(pos) FROM t_calendar)")
block("t_marks", "SELECT security_id, pos, open, last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM t_grid")
block("t_values", """
SELECT w.portfolio_id, p.as_of_date, p.entry_pos, p.exit_pos, d.pos, w.security_id, w.weight, w.weight * coalesce(d.mark / e.open, 1) AS v
FROM t_share_weights w JOIN t_periods p USING (as_of_date) JOIN t_marks e ON e.security_id = w.security_id AND e.pos = p.entry_pos AND e.open > 0
JOIN t_marks d ON d.security_id = w.security_id AND d.pos >= p.entry_pos AND d.pos < p.exit_pos
""")
block("t_levels", "SELECT portfolio_id, as_of_date, entry_pos, exit_pos, pos, sum(v) + 1 - sum(weight) AS level FROM t_values GROUP BY 1, 2, 3, 4, 5")
block("t_traded", """
SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.entry_pos, b.entry_pos) AS entry_pos, sum(abs(coalesce(a.weight, 0) - coalesce(b.drifted, 0))) AS turnover
FROM (SELECT portfolio_id, entry_pos, security_id, weight FROM t_values WHERE pos = entry_pos) a FULL JOIN
 (SELECT v.portfolio_id, v.exit_pos AS entry_pos, v.security_id, v.v / l.level AS drifted FROM t_values v JOIN t_levels l ON l.portfolio_id = v.portfolio_id AND l.as_of_date = v.as_of_date AND l.pos = v.pos WHERE v.pos = v.exit_pos - 1) b
 ON a.portfolio_id = b.portfolio_id AND a.entry_pos = b.entry_pos AND a.security_id = b.security_id GROUP BY 1, 2
""")
block("t_attributed", """
SELECT l.portfolio_id, l.as_of_date, l.pos, CASE WHEN l.pos = l.entry_pos THEN t.turnover END AS turnover,
  l.level / coalesce(lag(l.level) OVER (PARTITION BY l.portfolio_id, l.as_of_date ORDER BY l.pos), 1) * (1 - CASE WHEN l.pos = l.entry_pos THEN t.turnover * 0.0008 ELSE 0 END) - 1 AS ret
FROM t_levels l LEFT JOIN t_traded t ON t.portfolio_id = l.portfolio_id AND t.entry_pos = l.entry_pos
""")
block("t_attr_bench", "SELECT a.*, b.benchmark_return FROM t_attributed a JOIN t_calendar c USING (pos) JOIN t_benchmark b USING (date)")


def periods(spark, sf):
    """Quarterly decisions after the first year: filled at the next bar, held to the next fill."""
    last = tb.calendar(spark, sf).select(F.max("pos")).scalar()
    days = tb.calendar(spark, sf).where((F.col("pos") % 3 == 0) & (F.col("pos") < last))
    return days.select(F.col("date").alias("as_of_date"), (F.col("pos") + 1).alias("entry_pos"),
                       F.least(F.col("pos") + 4, last + 1).alias("exit_pos"))


def attributed(spark, sf):
    return staged(spark, sf, "attributed", lambda: po.attributed_returns(
        share_weights(spark, sf), tb.grid(spark, sf), periods(spark, sf), ["portfolio_id"], 8.0))


def with_benchmark(spark, sf, df):
    rets = se.equal_weight_returns(pl.returns(spark, sf))
    bench = rets.join(F.broadcast(tb.calendar(spark, sf)), "date").select("pos", "benchmark_return")
    return df.join(F.broadcast(bench), "pos")


@query("attributed_returns", "SELECT portfolio_id, as_of_date, pos, round(ret, 6) AS ret, round(turnover, 6) AS turnover FROM t_attributed")
def _(spark, sf):
    return rounded(attributed(spark, sf).select("portfolio_id", "as_of_date", "pos", "ret", "turnover"))


_PERF = ("log_growth", "cagr", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio",
         "cvar_95_daily", "downside_deviation", "hit_rate")


def perf_sql(source: str, key: str, extra: str = "") -> str:
    return f"""
SELECT {key}, n, {rnd(*_PERF, digits=5)}{extra} FROM (SELECT *, ln(1 + cumulative_return) AS log_growth, excess / annualized_volatility AS sharpe_ratio, CASE WHEN downside_deviation > 0 THEN excess / downside_deviation END AS sortino_ratio, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar_ratio
FROM (SELECT {key}, count(*) AS n, arg_max(eq, pos) - 1 AS cumulative_return, arg_max(eq, pos) ** (12.0::DOUBLE / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(12) AS annualized_volatility,
  avg(ret) * 12 AS excess, least(min(dd), 0) AS max_drawdown, sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(*)) * sqrt(12) AS downside_deviation,
  avg(ret) FILTER (WHERE ret <= cut) AS cvar_95_daily, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate
 FROM (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd, quantile_cont(ret, 0.05) OVER (PARTITION BY {key}) AS cut
  FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM {source})) GROUP BY 1))"""


@query("performance_summary", perf_sql("t_attributed", "portfolio_id"))
def _(spark, sf):
    df = pf.performance_summary(attributed(spark, sf), ["portfolio_id"], "pos", periods=12)
    return rounded(df.withColumn("cumulative_return", F.log1p("cumulative_return")).withColumnRenamed(
        "cumulative_return", "log_growth"), 5)


@query("window_statistics", f"""
SELECT s.*, i.information_ratio, i.active_return_annualized FROM ({perf_sql("t_attr_bench", "portfolio_id")}) s JOIN (
  SELECT portfolio_id, round(avg(ret - benchmark_return) / stddev_samp(ret - benchmark_return) * sqrt(12), 5) AS information_ratio,
    round(avg(ret - benchmark_return) * 12, 5) AS active_return_annualized FROM t_attr_bench GROUP BY 1) i USING (portfolio_id)""")
def _(spark, sf):
    stats = pf.window_stats(with_benchmark(spark, sf, attributed(spark, sf)), ["portfolio_id"], "pos", 12)
    return rounded(stats.withColumn("cumulative_return", F.log1p("cumulative_return")).withColumnRenamed("cumulative_return", "log_growth"), 5)


@query("portfolio_beta", "SELECT portfolio_id, round(covar_samp(ret, benchmark_return) / var_samp(benchmark_return), 6) AS beta FROM t_attr_bench GROUP BY 1")
def _(spark, sf):
    return rounded(rk.portfolio_beta(with_benchmark(spark, sf, attributed(spark, sf)), ["portfolio_id"], "ret", 1))


@query("survivorship_difference", """
WITH a AS (SELECT pos, avg(ret) AS ret FROM t_returns WHERE pos > 0 GROUP BY 1),
b AS (SELECT r.pos, avg(r.ret) AS ret FROM t_returns r WHERE r.pos > 0 AND r.security_id IN (SELECT security_id FROM t_prices WHERE pos = (SELECT max(pos) FROM t_calendar)) GROUP BY 1)
SELECT round((SELECT product(1 + coalesce(ret, 0)) ** (12.0::DOUBLE / count(*)) FROM b) - (SELECT product(1 + coalesce(ret, 0)) ** (12.0::DOUBLE / count(*)) FROM a), 5) AS cagr_difference""")
def _(spark, sf):
    rets = pl.returns(spark, sf).where("pos > 0").select("security_id", "pos", "ret")
    last = tb.calendar(spark, sf).select(F.max("pos")).scalar()
    alive = tb.prices(spark, sf).where(F.col("pos") == last).select("security_id")
    both = rets.withColumn("series", F.lit("all")).unionByName(
        rets.join(alive, "security_id", "left_semi").withColumn("series", F.lit("survivors")))
    daily = both.groupBy("series", "pos").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    return rounded(pf.relative_cagr(pf.performance_summary(daily, ["series"], "pos", periods=12), "survivors", "all"), 5)


# configurations: the regional portfolios compete, as parameter settings would
TRAIN, TEST = 24, 6
block("t_days", "SELECT DISTINCT pos, pos - (SELECT min(pos) FROM t_attributed) AS k FROM t_attributed")
block("t_config", "SELECT a.portfolio_id AS config_id, d.k AS pos, a.ret, a.benchmark_return FROM t_attr_bench a JOIN t_days d USING (pos)")
block("t_folds", f"SELECT DISTINCT (k - {TRAIN}) // {TEST} AS fold, (k - {TRAIN}) // {TEST} * {TEST} + {TRAIN} AS s FROM t_days WHERE k >= {TRAIN}")
block("t_fold_best", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_score DESC NULLS LAST, config_id) AS k FROM (
 SELECT f.fold, f.s, c.config_id, avg(ret - benchmark_return) / stddev_samp(ret - benchmark_return) * sqrt(12) AS train_score
 FROM t_folds f JOIN t_config c ON c.pos >= f.s - {TRAIN} AND c.pos < f.s GROUP BY 1, 2, 3)) WHERE k = 1
""")


def config_returns(spark, sf):
    df = with_benchmark(spark, sf, attributed(spark, sf))
    first = attributed(spark, sf).select(F.min("pos")).scalar()
    return df.select(F.col("portfolio_id").alias("config_id"), (F.col("pos") - first).alias("pos"), "ret", "benchmark_return")


def walk_forward(spark, sf):
    rows = staged(spark, sf, "config_returns", lambda: config_returns(spark, sf))
    days = rows.select("pos").distinct()
    return pf.walk_forward_selection(rows, days, TRAIN, TEST, pf.OBJECTIVES["information_ratio"](12))


@query("walk_forward_folds", f"""
SELECT b.fold, b.config_id, round(b.train_score, 6) AS train_score, b.s - {TRAIN} AS train_start, b.s - 1 AS train_end, b.s AS test_start,
  least(b.s + {TEST} - 1, (SELECT max(k) FROM t_days)) AS test_end FROM t_fold_best b""")
def _(spark, sf):
    return rounded(walk_forward(spark, sf)[1])


@query("walk_forward_returns", f"""
SELECT b.fold, c.pos, c.config_id, round(c.ret, 6) AS ret, round(c.benchmark_return, 6) AS benchmark_return
FROM t_fold_best b JOIN t_config c ON c.config_id = b.config_id AND c.pos >= b.s AND c.pos < b.s + {TEST}""")
def _(spark, sf):
    return rounded(walk_forward(spark, sf)[0])


@query("grid_summary", """
SELECT config_id, round(avg(ret - benchmark_return) / stddev_samp(ret - benchmark_return) * sqrt(12), 5) AS information_ratio,
  (SELECT count(*) FROM t_fold_best b WHERE b.config_id = c.config_id) AS times_chosen_walk_forward FROM t_config c GROUP BY 1""")
def _(spark, sf):
    stats = pf.window_stats(config_returns(spark, sf), ["config_id"], "pos", 12).select("config_id", "information_ratio")
    return rounded(pf.grid_summary(stats, walk_forward(spark, sf)[1], "information_ratio"), 5)


@query("best_configuration", """
SELECT config_id, round(avg(ret) / stddev_samp(ret) * sqrt(12), 5) AS sharpe FROM t_config GROUP BY 1 ORDER BY avg(ret) / stddev_samp(ret) DESC LIMIT 1""")
def _(spark, sf):
    scores = config_returns(spark, sf).groupBy("config_id").agg(pf.OBJECTIVES["sharpe"](12).alias("sharpe"))
    return rounded(pf.best_config(scores, "sharpe"), 5)


block("t_last_quotes", "SELECT security_id, max(pos) AS last_pos FROM t_prices WHERE close IS NOT NULL GROUP BY 1 HAVING max(pos) < (SELECT max(pos) FROM t_calendar)")


@query("backtest_totals", """
SELECT o.portfolio_id, round(avg(CASE WHEN k > 1 THEN turnover END), 6) AS avg_turnover_per_rebalance, count(*) AS n_rebalances, round(sum(turnover) * 800, 3) AS total_costs_usd,
  (SELECT count(*) FROM t_orders x JOIN t_calendar c ON c.date = x.as_of_date JOIN t_last_quotes q USING (security_id) WHERE x.portfolio_id = o.portfolio_id AND x.delta < 0 AND q.last_pos <= c.pos) AS delisted_liquidations,
  (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM t_share_weights w WHERE w.portfolio_id = o.portfolio_id GROUP BY as_of_date)) AS avg_holdings,
  (SELECT count(*) FROM t_orders x JOIN t_calendar c ON c.date = x.as_of_date LEFT JOIN t_grid g ON g.security_id = x.security_id AND g.pos = c.pos + 1 WHERE x.portfolio_id = o.portfolio_id AND x.delta <> 0 AND g.open IS NULL) AS unfilled_orders,
  (SELECT round(avg(volatility_annual), 6) FROM t_report r WHERE r.portfolio_id = o.portfolio_id) AS avg_ex_ante_volatility,
  (SELECT round(avg(gross_exposure), 6) FROM t_report r WHERE r.portfolio_id = o.portfolio_id) AS avg_gross_exposure,
  (SELECT count(DISTINCT as_of_date) FROM t_breaches b WHERE b.portfolio_id = o.portfolio_id) AS rebalances_with_risk_breaches
FROM (SELECT portfolio_id, as_of_date, sum(abs(delta)) AS turnover, row_number() OVER (PARTITION BY portfolio_id ORDER BY as_of_date) AS k FROM t_orders GROUP BY 1, 2) o GROUP BY 1""")
def _(spark, sf):
    """A sale of a name after its last quote is a liquidation."""
    plans, days = orders(spark, sf), tb.calendar(spark, sf)
    priced = po.order_costs(plans, F.lit(1_000_000.0), 1.0, 2.0, 5.0)
    gone = se.last_quotes(tb.prices(spark, sf), days).select("security_id", "last_pos")
    dated = priced.join(days.select(F.col("date").alias("as_of_date"), "pos"), "as_of_date").join(gone, "security_id", "left")
    side = F.when((F.col("side") == "SELL") & (F.col("last_pos") <= F.col("pos")), "DELISTED_SELL").otherwise(F.col("side"))
    trades = dated.select("portfolio_id", side.alias("side"), F.col("estimated_cost_usd").alias("cost_usd"))
    rebalances = po.plan_summary(plans, KEYS).select(
        "portfolio_id", F.col("as_of_date").alias("signal_date"), F.col("turnover").alias("planned_turnover"))
    holdings = share_weights(spark, sf).withColumnRenamed("as_of_date", "date")
    missed = po.unfilled_orders(plans, tb.grid(spark, sf), days)
    return rounded(pf.backtest_totals(trades, rebalances, holdings, missed, risk_tables(spark, sf)[1], breaches(spark, sf)), 6, total_costs_usd=3)


@query("proposal_orders", """
SELECT o.portfolio_id, o.as_of_date, o.security_id, round(delta * 1000000, 2) AS estimated_notional_usd, round(abs(delta) * 800, 4) AS estimated_cost_usd, s.ticker, g.decision,
  CASE WHEN is_entry THEN 'NEW_POSITION' WHEN is_exit THEN 'EXIT_POSITION' WHEN trades AND tgt > cur THEN 'INCREASE_TO_TARGET' WHEN trades AND tgt < cur THEN 'DECREASE_TO_TARGET' ELSE 'WITHIN_TRADE_BAND' END AS reason,
  CASE WHEN g.decision IS NULL THEN 'Fuera del universo elegible' ELSE 'Señal ' || g.decision || ' (score' END AS signal
FROM t_orders o JOIN t_securities s ON s.security_id = o.security_id LEFT JOIN t_signals g ON g.as_of_date = o.as_of_date AND g.security_id = o.security_id WHERE trades OR tgt <> cur""")
def _(spark, sf):
    nav = orders(spark, sf).withColumn("nav", F.lit(1_000_000.0))
    shown = po.proposal_orders(nav, pl.signals(spark, sf), tb.securities(spark, sf), KEYS, tb.STRATEGY.costs)
    text = F.regexp_replace(F.get("reasons", F.lit(1)), r" [0-9.]+\)$", "").alias("signal")  # the score's rounding apart
    columns = ("estimated_notional_usd", "estimated_cost_usd", "ticker", "decision", F.get("reasons", F.lit(0)).alias("reason"), text)
    return rounded(shown.select(*KEYS, "security_id", *columns), 2, estimated_cost_usd=4)
