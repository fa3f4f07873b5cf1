"""Book, read-side and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.config import FAMILIES
from quantloom.functions import ranking as rk
from quantloom.operators import book as bk, ml, performance as pf, research as rs, series as se, views as vw
from quantloom.operators.asof import asof_join
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans.oracle import block, percentile_of, percentile_sql
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.q_portfolio import KEYS, current_weights, orders
from quantloom.plans.registry import query, rounded, staged
from quantloom.config import FEATURES

# ---------------------------------------------------------------- book
block("t_fills", "SELECT l_orderkey AS order_id, l_suppkey AS security_id, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_linestatus FROM lineitem")


def fills(spark, sf):
    sign = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return tb.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("security_id"), sign.alias("qty"), "l_linestatus")


@query("implied_positions", "SELECT security_id, sum(qty) AS qty FROM t_fills GROUP BY 1 HAVING abs(sum(qty)) > 1e-9")
def _(spark, sf):
    return bk.implied_positions(fills(spark, sf))


@query("filled_quantities", "SELECT o_orderkey AS order_id, coalesce(sum(abs(qty)), 0) AS filled_qty FROM orders LEFT JOIN t_fills ON order_id = o_orderkey GROUP BY 1")
def _(spark, sf):
    return bk.filled_quantities(tb.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), fills(spark, sf))


@query("execution_summary", """
SELECT proposal_id, filled, submitted, rejected, CASE WHEN filled = n THEN 'EXECUTED' WHEN filled + submitted = 0 THEN 'FAILED' ELSE 'PARTIALLY_EXECUTED' END AS status
FROM (SELECT o_custkey AS proposal_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS submitted,
 count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected FROM orders GROUP BY 1)""")
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("SUBMITTED")
    return bk.execution_summary(tb.read(spark, sf, "orders").select(F.col("o_custkey").alias("proposal_id"), status.alias("status")))


@query("position_breaks", """
WITH b AS (SELECT security_id, sum(qty) AS q FROM t_fills WHERE l_linestatus = 'F' OR security_id % 3 = 0 GROUP BY 1), l AS (SELECT security_id, sum(qty) AS q FROM t_fills WHERE security_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(b.security_id, l.security_id) AS security_id, coalesce(b.q, 0) AS broker, coalesce(l.q, 0) AS ledger, CASE WHEN l.q IS NULL THEN 'UNTRACKED_AT_BROKER' ELSE 'QUANTITY_MISMATCH' END AS type
FROM b FULL JOIN l ON b.security_id = l.security_id WHERE abs(coalesce(b.q, 0) - coalesce(l.q, 0)) > 1e-4""")
def _(spark, sf):
    f = fills(spark, sf)
    broker = bk.implied_positions(f.where("l_linestatus = 'F' or security_id % 3 = 0"), -1.0)
    return bk.reconcile(broker, bk.implied_positions(f.where("security_id % 5 <> 0"), -1.0))


@query("book_weights", """
WITH p AS (SELECT security_id, sum(qty) AS qty FROM t_fills GROUP BY 1 HAVING abs(sum(qty)) > 1e-9),
v AS (SELECT p.security_id, p.qty, x.price, p.qty * coalesce(x.price, 0) AS value FROM p LEFT JOIN (SELECT security_id, arg_max(price_close, date) AS price FROM t_bars GROUP BY 1) x USING (security_id))
SELECT security_id, qty, round(price, 5) AS price, round(value, 4) AS value, round(value / (SELECT sum(value) + 1000000 FROM v), 9) AS weight, security_id IN (SELECT security_id FROM t_securities WHERE sector_id <> 'ASIA') AS managed FROM v""".replace("round(price, 5) AS price, round(value, 4) AS value", "value"))
def _(spark, sf):
    managed = tb.securities(spark, sf).where("sector_id <> 'ASIA'")
    df = bk.book_weights(bk.implied_positions(fills(spark, sf)), bk.last_prices(tb.bars(spark, sf)), managed, 1_000_000.0)
    return rounded(df.drop("price"), 9, exact=("value",))


EQUITY = 5_000_000.0
_step = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
block("t_order_prices", """
SELECT o.*, b.price_close AS price FROM (SELECT * FROM t_orders WHERE delta <> 0) o
ASOF LEFT JOIN (SELECT security_id, date, price_close FROM t_bars WHERE price_close IS NOT NULL) b ON b.security_id = o.security_id AND b.date <= o.as_of_date
""")
block("t_sized", f"""
SELECT portfolio_id, as_of_date, security_id, side, qty, qty * price AS est, tgt FROM (
 SELECT *, CASE WHEN price > 0 THEN CASE WHEN side = 'BUY' THEN {_step('raw * (1 - 0.005::DOUBLE)')} WHEN tgt <= 0 THEN held ELSE least(raw, held) END END AS qty FROM (
  SELECT portfolio_id, as_of_date, security_id, tgt, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, price, {_step(f'abs(delta * {EQUITY}::DOUBLE) / price')} AS raw, {_step('cur * 3000')} AS held FROM t_order_prices))
""")


def sized(spark, sf):
    """Each order at the last price known on its own date."""
    wanted = orders(spark, sf)
    known = tb.bars(spark, sf).where("price_close is not null").select("security_id", "date", F.col("price_close").alias("price"))
    prices = asof_join(wanted.select("security_id", "as_of_date").distinct(), known, ["price"], time="date")
    held = current_weights(spark, sf).withColumn("qty", bk.share_step(F.col("weight") * 3000))
    return bk.sized_orders(wanted, prices, held, KEYS, EQUITY)


@query("pre_trade_checks", f"""
SELECT portfolio_id, as_of_date, count(qty) AS n_orders, count(*) FILTER (WHERE bad) AS failed_checks, count(*) FILTER (WHERE bad) = 0 AND count(qty) <= 15 AS pre_trade_ok
FROM (SELECT DISTINCT portfolio_id, as_of_date FROM t_orders) LEFT JOIN (
  SELECT *, est IS NULL OR (est > 0.1 * {EQUITY} + 1e-6 AND NOT (side = 'SELL' AND tgt <= 0)) AS bad FROM t_sized WHERE est IS NULL OR est >= 25) USING (portfolio_id, as_of_date) GROUP BY 1, 2""")
def _(spark, sf):
    return bk.pre_trade_checks(sized(spark, sf), KEYS, max_orders=15, proposals=orders(spark, sf))


@query("sized_orders", "SELECT portfolio_id, as_of_date, security_id, side, round(qty, 4) AS qty FROM t_sized WHERE est IS NULL OR est >= 25")
def _(spark, sf):
    from quantloom.operators.portfolio import sells_first

    return rounded(sells_first(sized(spark, sf)).select(*KEYS, "security_id", "side", "qty"), 4)


@query("latest_order_per_customer", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::DATE AS day, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1""")
def _(spark, sf):
    o = tb.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return bk.latest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")


@query("audit_tail", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    return bk.last_rows(tb.read(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "event_type", "user_id")


@query("audit_trail", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id")
def _(spark, sf):
    return bk.audit_trail(tb.read(spark, sf, "events"), ["ts", "event_id"], event_type="purchase").select("event_id", "user_id", "value")


@query("daily_equity_points", "SELECT CAST(ts AS DATE) AS date, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _(spark, sf):
    return bk.one_per_day(tb.read(spark, sf, "events"), "ts", "value")


# ---------------------------------------------------------------- read side
@query("rankings_top", """
SELECT security_id, ticker, decision, round(composite_score, 6) AS composite_score FROM t_signals WHERE as_of_date = DATE '2000-06-30' ORDER BY t_signals.composite_score DESC, security_id LIMIT 25""")
def _(spark, sf):
    top = vw.rankings(pl.signals(spark, sf), F.lit("2000-06-30").cast("date"), limit=25)
    return rounded(top.select("security_id", "ticker", "decision", "composite_score"))


@query("rankings_filtered", """
SELECT as_of_date, security_id, ticker, rank, round(revisions_score, 6) AS revisions_score FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY composite_score DESC, security_id) AS rank FROM t_signals)
WHERE decision = 'WATCH' AND sector_id = 'EUROPE' AND ticker LIKE '%1%'""")
def _(spark, sf):
    df = pl.signals(spark, sf).withColumn("_key", -F.col("composite_score"))
    ranked = rk.first_rank(df, ["as_of_date"], "_key", "security_id", "rank")
    out = vw.filter_rankings(ranked, "WATCH", "EUROPE", "1", sort="revisions_score", descending=True)
    return rounded(out.select("as_of_date", "security_id", "ticker", "rank", "revisions_score"))


@query("top_per_date", "SELECT as_of_date, security_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY composite_score DESC, security_id) AS r FROM t_signals) WHERE r <= 10")
def _(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("as_of_date").orderBy(F.desc("composite_score"), "security_id")
    ranked = pl.signals(spark, sf).select("as_of_date", "security_id", F.row_number().over(order).alias("rank"))
    return rounded(ranked.where("rank <= 10"))


@query("security_search", """
SELECT security_id, ticker FROM t_securities WHERE ticker LIKE '%9%' OR CAST(security_id AS VARCHAR) LIKE '%9%' ORDER BY CASE WHEN starts_with(upper(ticker), '9') THEN 0 ELSE 1 END, ticker LIMIT 8""")
def _(spark, sf):
    return vw.search_securities(tb.securities(spark, sf), "9").select("security_id", "ticker")


@query("sector_counts", """
SELECT as_of_date, sector_id, count(*) AS count, count(*) FILTER (WHERE decision IN ('STRONG_LONG', 'LONG', 'WATCH')) AS positive,
  round(count(*) FILTER (WHERE decision IN ('STRONG_LONG', 'LONG', 'WATCH')) / CAST(count(*) AS DOUBLE), 6) AS positive_share FROM t_signals GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(vw.sector_counts(pl.signals(spark, sf)).orderBy(F.desc("positive_share")))


_MED = ", ".join(f"round(quantile_cont({f}_score, 0.5), 6) AS {f}_median" for f in FAMILIES)


@query("sector_median_scores", f"SELECT as_of_date, sector_id, {_MED} FROM t_signals GROUP BY 1, 2")
def _(spark, sf):
    return rounded(vw.sector_medians(pl.signals(spark, sf), FAMILIES))


@query("score_changes", """
SELECT s.as_of_date, s.security_id, v.lag::BIGINT AS lag, c2.date AS past_date, round(p.composite_score, 6) AS past_score, round(s.composite_score - p.composite_score, 6) AS delta
FROM t_signals s CROSS JOIN (VALUES (1), (3), (6)) v(lag) JOIN t_calendar c ON c.date = s.as_of_date JOIN t_calendar c2 ON c2.pos = c.pos - v.lag
LEFT JOIN t_signals p ON p.as_of_date = c2.date AND p.security_id = s.security_id""")
def _(spark, sf):
    df = vw.score_changes(pl.signals(spark, sf), tb.calendar(spark, sf), (1, 3, 6))
    return rounded(df.select("as_of_date", "security_id", "lag", "past_date", "past_score", "delta"))


_LISTED = ("earnings_yield", "fcf_yield", "ev_ebitda", "revenue_growth", "eps_growth", "roic", "gross_margin", "fcf_margin", "net_debt_ebitda", "mom_12_1", "eps_rev_30d", "eps_rev_90d", "revisions_up_ratio")


@query("security_analysis", f"""
SELECT f.as_of_date, f.security_id, f.reasons = '' AS eligible, round(f.ret_1m, 6) AS ret_1m, round(f.mom_3m, 6) AS mom_3m, s.decision, round(s.composite_score, 6) AS composite_score,
  round(m.value_median, 6) AS value_median, concat_ws(',', {", ".join(f"CASE WHEN f.{c} IS NULL THEN '{c}' END" for c in _LISTED)}) AS missing_data
FROM t_screened f LEFT JOIN t_signals s ON s.as_of_date = f.as_of_date AND s.security_id = f.security_id
LEFT JOIN (SELECT as_of_date, sector_id, quantile_cont(value_score, 0.5) AS value_median FROM t_signals GROUP BY 1, 2) m ON m.as_of_date = f.as_of_date AND m.sector_id = f.sector_id""")
def _(spark, sf):
    from quantloom.operators.crosssection import with_eligibility

    signals = pl.signals(spark, sf)
    features = with_eligibility(pl.snapshot(spark, sf), tb.STRATEGY.eligibility)
    df = vw.security_analysis(features, signals, vw.sector_medians(signals, FAMILIES), FAMILIES)
    return rounded(df.select("as_of_date", "security_id", "eligible", "ret_1m", "mom_3m", "decision", "composite_score", "value_median",
                             F.array_join("missing_data", ",").alias("missing_data")))


@query("score_history", """
SELECT c.date AS as_of_date, s.security_id, round(g.composite_score, 6) AS composite_score, g.decision FROM t_calendar c CROSS JOIN t_securities s
LEFT JOIN t_signals g ON g.as_of_date = c.date AND g.security_id = s.security_id WHERE c.pos > (SELECT max(pos) FROM t_calendar) - 24""")
def _(spark, sf):
    days = tb.calendar(spark, sf)
    recent = days.where(F.col("pos") > tb.last_position(days) - 24).select(F.col("date").alias("as_of_date"))
    df = vw.score_history(pl.signals(spark, sf), recent, tb.securities(spark, sf))
    return rounded(df.select("as_of_date", "security_id", "composite_score", "decision"))


@query("decision_changes", """
SELECT as_of_date, security_id, decision, previous_decision FROM (SELECT *, lag(decision) OVER (PARTITION BY security_id ORDER BY as_of_date) AS previous_decision FROM t_signals) WHERE decision IS DISTINCT FROM previous_decision""")
def _(spark, sf):
    points = pl.signals(spark, sf).select("as_of_date", "security_id", "decision")
    return se.decision_changes(points)


@query("securities_list", "SELECT security_id, ticker, sector_id, security_id IN (SELECT security_id FROM t_prices WHERE close IS NOT NULL) AS has_prices FROM t_securities")
def _(spark, sf):
    return vw.securities_list(tb.securities(spark, sf), tb.prices(spark, sf).where("close is not null"))


@query("overview_benchmark", """
WITH b AS (SELECT c.pos, b.date, product(1 + coalesce(benchmark_return, 0)) OVER (ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM t_benchmark b JOIN t_calendar c USING (date))
SELECT date, round(level / (SELECT level FROM b WHERE pos = (SELECT max(pos) FROM b) - 59) * 100, 4) AS value FROM b WHERE pos >= (SELECT max(pos) FROM b) - 59""")
def _(spark, sf):
    daily = se.equal_weight_returns(se.with_returns(tb.grid(spark, sf))).join(F.broadcast(tb.calendar(spark, sf)), "date")
    level = daily.withColumn("_one", F.lit(1)).withColumn("level", se.cumulative_growth("benchmark_return", ["_one"], "pos"))
    start = tb.last_position(tb.calendar(spark, sf)) - 59
    recent = level.where(F.col("pos") >= start).withColumn("value", se.rebase("level", ["_one"], "pos"))
    return rounded(recent.select("date", "value"), 4)


@query("json_safe_values", """
SELECT l_suppkey AS security_id, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, CASE WHEN sum(l_tax) = 0 THEN NULL ELSE round(sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE), 9) END AS ratio FROM lineitem GROUP BY 1""")
def _(spark, sf):
    from quantloom.functions import scalars as sc

    df = tb.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("security_id")).agg(
        sc.iso_date(F.max("l_shipdate")).alias("last_day"), F.sum(tb.units(F.col("l_discount"), 100)).alias("_d"), F.sum(tb.units(F.col("l_tax"), 100)).alias("_t"))
    return rounded(df.select("security_id", "last_day", sc.json_safe(sc.ratio("_d", "_t")).alias("ratio")), 9)


# ---------------------------------------------------------------- models
block("t_ml_pct", percentile_sql("t_signals", FEATURES))
block("t_ml_wide", "SELECT as_of_date, security_id, " + ", ".join(
    f"max(CASE WHEN factor = '{f}' AND known >= 5 THEN pct END) AS pct_{f}" for f in FEATURES) +
    " FROM (SELECT *, count(*) OVER (PARTITION BY as_of_date, factor) AS known FROM t_ml_pct) GROUP BY 1, 2")
block("t_ml_panel", f"""
SELECT s.as_of_date, s.security_id, {", ".join(f"w.pct_{f}" for f in FEATURES)}, {", ".join(f"s.{f}_score / 100 AS {f}_score" for f in FAMILIES)},
  {percentile_of("s.volatility_63d", "s.as_of_date")} AS pct_volatility_63d, {percentile_of("s.adv_usd", "s.as_of_date")} AS pct_adv_usd, f.forward_return, f.exit_date AS label_known_at,
  {percentile_of("f.forward_return", "s.as_of_date")} AS target
FROM t_signals s LEFT JOIN t_ml_wide w ON w.as_of_date = s.as_of_date AND w.security_id = s.security_id
LEFT JOIN t_raw_forward f ON f.as_of_date = s.as_of_date AND f.security_id = s.security_id
""")
_X = ml.feature_columns()


def panel(spark, sf):
    def build():
        fwd = rs.forward_returns(tb.grid(spark, sf), pl.legs(spark, sf, (1,)), filled=False)
        features = staged(spark, sf, "ml_features", lambda: ml.model_features(pl.with_features(spark, sf, pl.signals(spark, sf))))
        return ml.training_panel(features, fwd)

    return staged(spark, sf, "ml_panel", build)


@query("training_panel", f"SELECT as_of_date, security_id, {rnd(*_X, 'target', digits=9)}, round(forward_return, 6) AS forward_return, label_known_at FROM t_ml_panel")
def _(spark, sf):
    return rounded(panel(spark, sf).select("as_of_date", "security_id", *_X, "target", "forward_return", "label_known_at"), 9, forward_return=6)


@query("purged_training_rows", """
SELECT as_of_date, count(*) AS n FROM t_ml_panel WHERE target IS NOT NULL AND label_known_at < DATE '2000-01-31' AND as_of_date >= DATE '1998-01-31' GROUP BY 1""")
def _(spark, sf):
    rows = ml.train_rows(panel(spark, sf), "2000-01-31", 2.0)
    return rows.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))


@query("population_stability", "SELECT feature, round(psi, 6) AS psi FROM (" + " UNION ALL ".join(f"""
SELECT '{x}' AS feature, CASE WHEN (SELECT count({x}) FROM t_ml_panel WHERE as_of_date < DATE '1999-12-31') >= 10 AND (SELECT count({x}) FROM t_ml_panel WHERE as_of_date >= DATE '1999-12-31') >= 10 THEN
 (SELECT CASE WHEN len(any_value(q)) < 3 THEN 0.0::DOUBLE ELSE sum((a - e) * ln(a / e)) END FROM (
  SELECT any_value(q) AS q, b.b, greatest(count(*) FILTER (WHERE bin = b.b AND old) / CAST(any_value(ne) AS DOUBLE), 1e-6) AS e, greatest(count(*) FILTER (WHERE bin = b.b AND NOT old) / CAST(any_value(na) AS DOUBLE), 1e-6) AS a
  FROM (SELECT q, as_of_date < DATE '1999-12-31' AS old, len(list_filter(q[2:len(q) - 1], lambda z: z <= {x})) AS bin, count(*) FILTER (WHERE as_of_date < DATE '1999-12-31') OVER () AS ne, count(*) FILTER (WHERE as_of_date >= DATE '1999-12-31') OVER () AS na
        FROM t_ml_panel CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont({x}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM t_ml_panel WHERE as_of_date < DATE '1999-12-31') WHERE {x} IS NOT NULL) p
  JOIN (SELECT unnest(range(0, 10)) AS b) b ON b.b <= len(q) - 2 GROUP BY b.b)) END AS psi""" for x in _X) + ")")
def _(spark, sf):
    p = panel(spark, sf)
    day = F.col("as_of_date")
    return rounded(ml.population_stability(p.where(day < "1999-12-31"), p.where(day >= "1999-12-31"), _X))


@query("gradient_boosted_fit")
def _(spark, sf):
    """One purged fit of the boosted model with the operator's parameters, scored on the next dates."""
    model = ml.fit_model(ml.train_rows(panel(spark, sf), "2000-06-30", 2.0), "gbm", _X)
    after = panel(spark, sf).where("as_of_date >= DATE '2000-06-30'")
    return rounded(ml.score_rows(model, after, _X).select("as_of_date", "security_id", "raw_score"))
