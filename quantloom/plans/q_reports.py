"""The model portfolio, rebalance proposals and ticker reports of every date."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.config import FAMILIES
from quantloom.operators import enforcement as en, portfolio as po, risk as rk, series as se, views as vw
from quantloom.operators.crosssection import with_eligibility
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans import q_enforcement as qe, q_portfolio as qp
from quantloom.plans.oracle import BLOCKS, block
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.registry import query, rounded, staged

KEYS, LIMITS = qp.KEYS, tb.STRATEGY.risk
RISK = ("gross_exposure", "herfindahl", "volatility_annual", "var_95_daily", "beta")

block("t_final_weights", "SELECT f.portfolio_id, f.as_of_date, f.security_id, f.weight * s.scale AS weight FROM t_e_flat f JOIN t_e_scaled s USING (portfolio_id, as_of_date) WHERE f.weight * s.scale > 1e-12")


def report_blocks(t: str, weights: str) -> None:
    """Risk blocks and ``{t}report`` of a weights table."""
    qp.risk_blocks(t, weights)
    for name in ("hist", "report"):
        block(f"{t}{name}", BLOCKS[f"t_{name}"].replace("t_hist", f"{t}hist").replace("t_variance", f"{t}variance").replace("t_window", f"{t}window"))


report_blocks("t_mp_", "t_final_weights")
block("t_mp_broken", f"""
SELECT portfolio_id, as_of_date, 'PORTFOLIO_VOLATILITY' AS code FROM t_mp_report WHERE volatility_annual > {LIMITS.max_portfolio_volatility} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'VAR_95' FROM t_mp_report WHERE var_95_daily > {LIMITS.max_var_95_daily} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'BETA' FROM t_mp_report WHERE beta > {LIMITS.max_beta} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'SECTOR_CONCENTRATION' FROM t_final_weights JOIN t_securities USING (security_id) GROUP BY 1, 2, sector_id HAVING sum(weight) > {qe.SIZING.max_sector_weight} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'INDUSTRY_CONCENTRATION' FROM t_final_weights JOIN t_securities USING (security_id) GROUP BY 1, 2, industry_id HAVING sum(weight) > {LIMITS.max_industry_weight} + 1e-6
UNION ALL SELECT portfolio_id, as_of_date, 'RISK_CONTRIBUTION' FROM t_mp_contrib WHERE risk_contribution > {LIMITS.max_single_name_risk_contribution} + 1e-6
""")


def risk_of(spark, sf, name, weights):
    """Staged report and contributions of a weights table (keys, security_id, weight)."""
    held = weights.select(*KEYS, "security_id", "weight")
    days, returns = tb.calendar(spark, sf), pl.returns(spark, sf)
    named = staged(spark, sf, f"{name}_names", lambda: rk.name_moments(rk.held_windows(returns, held, days, qp.LOOKBACK)))
    scalars = staged(spark, sf, f"{name}_scalars", lambda: rk.shrinkage(named, rk.window_sums(named, KEYS), KEYS))
    report, shares = rk.windows_report(
        named, scalars, se.equal_weight_returns(returns), KEYS, periods=12,
        materialize=lambda df: staged(spark, sf, f"{name}_sigma", lambda: df))
    return staged(spark, sf, f"{name}_report", lambda: report), staged(spark, sf, f"{name}_shares", lambda: shares)


def final_weights(spark, sf):
    return staged(spark, sf, "final_weights", lambda: en.enforced_weights(qe.enforced(spark, sf), KEYS).drop("before"))


@query("model_portfolio", f"""
SELECT w.portfolio_id, w.as_of_date, w.security_id, s.ticker, s.sector_id, g.decision, round(w.weight, 6) AS weight, round(c.risk_contribution, 5) AS risk_contribution,
  round(g.composite_score, 6) AS composite_score, round(g.volatility_63d, 6) AS volatility_63d
FROM t_final_weights w JOIN t_securities s USING (security_id) JOIN t_mp_contrib c ON c.portfolio_id = w.portfolio_id AND c.as_of_date = w.as_of_date AND c.security_id = w.security_id
LEFT JOIN t_signals g ON g.as_of_date = w.as_of_date AND g.security_id = w.security_id""")
def _(spark, sf):
    weights = final_weights(spark, sf)
    out = vw.model_portfolio(weights, risk_of(spark, sf, "model", weights)[1], pl.signals(spark, sf), tb.securities(spark, sf), KEYS)
    columns = ("security_id", "ticker", "sector_id", "decision", "weight", "risk_contribution", "composite_score", "volatility_63d")
    return rounded(out.select(*KEYS, *columns), 6, risk_contribution=5)


@query("portfolio_overview", f"""
SELECT w.portfolio_id, w.as_of_date, n_holdings, round(cash_weight, 6) AS cash_weight, {rnd(*RISK, digits=5)}, coalesce(b.breaches, '') AS breaches
FROM (SELECT portfolio_id, as_of_date, count(*) AS n_holdings, 1 - sum(weight) AS cash_weight FROM t_final_weights GROUP BY 1, 2) w JOIN t_mp_report r USING (portfolio_id, as_of_date)
LEFT JOIN (SELECT portfolio_id, as_of_date, string_agg(DISTINCT code, ',' ORDER BY code) AS breaches FROM t_mp_broken GROUP BY 1, 2) b USING (portfolio_id, as_of_date)""")
def _(spark, sf):
    weights, secs = final_weights(spark, sf), tb.securities(spark, sf)
    report, shares = risk_of(spark, sf, "model", weights)
    exposure = lambda group: rk.group_exposure(weights, secs, KEYS, group)
    broken = rk.limit_breaches(report, exposure("sector_id"), exposure("industry_id"), shares, KEYS, LIMITS, qe.SIZING.max_sector_weight)
    out = vw.portfolio_overview(weights, qe.enforced(spark, sf), report, broken, KEYS)
    return rounded(out.select(*KEYS, "n_holdings", "cash_weight", *RISK, "breaches"), 5, cash_weight=6)


# ---------------------------------------------------------------- proposals
block("t_book_before", "SELECT portfolio_id, as_of_date, security_id, cur AS weight FROM t_orders WHERE cur > 0")
block("t_book_after", "SELECT portfolio_id, as_of_date, security_id, greatest(cur + delta, 0) AS weight FROM t_orders WHERE cur + delta > 1e-12")
report_blocks("t_bb_", "t_book_before")
report_blocks("t_ba_", "t_book_after")
_BEFORE_AFTER = ", ".join(f"round({a}.{c}, 5) AS {c}_{when}" for a, when in (("b", "before"), ("a", "after")) for c in RISK)


@query("proposal_summary", f"""
SELECT o.portfolio_id, o.as_of_date, round(estimated_turnover, 5) AS estimated_turnover, turnover_capped, n_orders, round(estimated_cost_usd, 3) AS estimated_cost_usd, {_BEFORE_AFTER}, coalesce(n_alerts, 0) AS n_alerts
FROM (SELECT portfolio_id, as_of_date, sum(abs(delta)) AS estimated_turnover, bool_or(capped) AS turnover_capped, count(*) FILTER (WHERE delta <> 0) AS n_orders, sum(abs(delta)) * 800 AS estimated_cost_usd FROM t_orders GROUP BY 1, 2) o
LEFT JOIN t_bb_report b ON b.portfolio_id = o.portfolio_id AND b.as_of_date = o.as_of_date LEFT JOIN t_ba_report a ON a.portfolio_id = o.portfolio_id AND a.as_of_date = o.as_of_date
LEFT JOIN (SELECT w.portfolio_id, w.as_of_date, count(*) AS n_alerts FROM t_book_before w JOIN t_alerts x ON x.as_of_date = w.as_of_date AND x.security_id = w.security_id GROUP BY 1, 2) n ON n.portfolio_id = o.portfolio_id AND n.as_of_date = o.as_of_date""")
def _(spark, sf):
    """Each regional book before and after its orders; alerts on names it holds."""
    orders = qp.orders(spark, sf)
    now = orders.where("current_weight > 0").select(*KEYS, "security_id", F.col("current_weight").alias("weight"))
    then = orders.where("final_weight > 1e-12").select(*KEYS, "security_id", F.col("final_weight").alias("weight"))
    cost = po.order_costs(orders, F.lit(1_000_000.0), 1.0, 2.0, 5.0).groupBy(*KEYS).agg(F.sum("estimated_cost_usd").alias("estimated_cost_usd"))
    alerts = now.join(qp.signal_alerts(spark, sf).select("as_of_date", "security_id", "code"), ["as_of_date", "security_id"])
    out = vw.proposal_summary(orders, risk_of(spark, sf, "before", now)[0], risk_of(spark, sf, "after", then)[0], cost, alerts, KEYS)
    measures = [f"{c}_{when}" for when in ("before", "after") for c in RISK]
    return rounded(out.select(*KEYS, "estimated_turnover", "turnover_capped", "n_orders", "estimated_cost_usd", *measures, "n_alerts"), 5, estimated_cost_usd=3)


# ---------------------------------------------------------------- tickers
_MEDIANS = ", ".join(f"quantile_cont({f}_score, 0.5) AS {f}_median" for f in FAMILIES)
_FAMILIES = [c for f in FAMILIES for c in (f"{f}_score", f"{f}_median")]


@query("ticker_report", f"""
SELECT f.as_of_date, f.security_id, CASE WHEN f.reasons = '' AND s.decision IS NOT NULL THEN NULL WHEN f.reasons <> '' THEN replace(f.reasons, ',', ', ') ELSE 'insufficient fundamental coverage' END AS not_scored,
  s.decision, {rnd('composite_percentile', *_FAMILIES)}, round(f.ret_1m, 6) AS ret_1m, round(f.mom_3m, 6) AS mom_3m, round(f.mom_6m, 6) AS mom_6m, round(w.weight, 6) AS model_weight
FROM t_screened f LEFT JOIN t_signals s ON s.as_of_date = f.as_of_date AND s.security_id = f.security_id
LEFT JOIN (SELECT as_of_date, sector_id, {_MEDIANS} FROM t_signals GROUP BY 1, 2) m ON m.as_of_date = f.as_of_date AND m.sector_id = f.sector_id
LEFT JOIN t_final_weights w ON w.portfolio_id = 'inverse_volatility' AND w.as_of_date = f.as_of_date AND w.security_id = f.security_id""")
def _(spark, sf):
    signals = pl.signals(spark, sf)
    features = with_eligibility(pl.snapshot(spark, sf), tb.STRATEGY.eligibility)
    analysis = vw.security_analysis(features, signals, vw.sector_medians(signals, FAMILIES), FAMILIES)
    model = final_weights(spark, sf).where("portfolio_id = 'inverse_volatility'")
    out = vw.ticker_report(analysis, model)
    return rounded(out.select("as_of_date", "security_id", "not_scored", "decision", "composite_percentile", *_FAMILIES, "ret_1m", "mom_3m", "mom_6m", "model_weight"))
