"""Tuning over a grid of strategy configurations, with a holdout no selection sees."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quantloom.operators import portfolio as po, tuning as tu
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans import q_portfolio as qp
from quantloom.plans.oracle import BLOCKS, block, composite_sql, labels_sql
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.registry import query, rounded, staged
from quantloom.session import cut_lineage

GRID = {
    "composite_weights": (
        dict(tb.STRATEGY.composite_weights),
        {"value": 0.15, "growth": 0.15, "profitability": 0.20, "momentum": 0.35, "revisions": 0.15},
    ),
    "signals.long_composite_percentile": (0.85, 0.70),
    "portfolio.weighting": ("inverse_volatility", "equal_weight"),
}
CONFIGS = tu.configurations(tb.STRATEGY, GRID)
TRAIN, TEST, HOLDOUT, PERIODS = 18, 6, 48, 12  # bars; the holdout begins at this bar of the returns

# ---------------------------------------------------------------- SQL: every configuration spelt out
_SETS = tu.scoring_sets(CONFIGS)
for _n, _strategy in dict(_SETS.values()).items():
    block(f"t_tu_composite_{_n}", composite_sql(_strategy.composite_weights))
    block(f"t_tu_scored_{_n}", BLOCKS["t_scored"].replace("t_composite", f"t_tu_composite_{_n}"))
for _c, _strategy in CONFIGS.items():
    block(f"t_tu_labels_{_c}", labels_sql(_strategy.signals, f"t_tu_scored_{_SETS[_c][0]}"))
block("t_tu_signals", " UNION ALL ".join(
    f"SELECT '{c}' AS config_id, '{s.portfolio.weighting}' AS weighting, as_of_date, security_id, sector_id, composite_score, decision, volatility_63d FROM t_tu_labels_{c}" for c, s in CONFIGS.items()))
_S = qp.SIZING
block("t_tu_chosen", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, as_of_date ORDER BY cls, composite_score DESC, security_id) AS r FROM (
  SELECT *, CASE WHEN decision IN ('STRONG_LONG', 'LONG') THEN 1 WHEN decision = 'WATCH' THEN 2 WHEN decision = 'NEUTRAL' THEN 3 END AS cls FROM t_tu_signals) WHERE cls IS NOT NULL)
WHERE (cls = 1 AND r <= {_S.max_holdings}) OR (cls >= 2 AND r <= {_S.min_holdings})
""")
block("t_tu_cap_0", """
SELECT config_id, as_of_date, security_id, sector_id, w AS base, w FROM (
  SELECT *, raw / sum(raw) OVER (PARTITION BY config_id, as_of_date) AS w FROM (
    SELECT c.*, CASE WHEN weighting = 'equal_weight' THEN 1.0::DOUBLE ELSE 1 / greatest(coalesce(volatility_63d, quantile_cont(volatility_63d, 0.5) OVER (PARTITION BY config_id, as_of_date), 1), 0.05) END AS raw FROM t_tu_chosen c))
""")
for _i in range(qp.PASSES):
    _pass = BLOCKS[f"t_cap_{_i + 1}"].replace("t_cap_", "t_tu_cap_").replace("PARTITION BY as_of_date", "PARTITION BY config_id, as_of_date").replace("SELECT as_of_date", "SELECT config_id, as_of_date")
    block(f"t_tu_cap_{_i + 1}", _pass)
block("t_tu_weights", f"SELECT config_id AS portfolio_id, as_of_date, security_id, w AS weight FROM t_tu_cap_{qp.PASSES} WHERE w > 0")
for _name in ("values", "levels", "traded", "attributed"):
    block(f"t_tu_{_name}", re.sub(r"\bt_(values|levels|traded)\b", r"t_tu_\1", BLOCKS[f"t_{_name}"]).replace("t_share_weights", "t_tu_weights"))
block("t_tu_returns", """
SELECT a.portfolio_id AS config_id, a.pos - (SELECT min(pos) FROM t_tu_attributed) AS pos, a.ret, a.turnover, b.benchmark_return
FROM t_tu_attributed a JOIN t_calendar c USING (pos) JOIN t_benchmark b USING (date)
""")
block("t_tu_before", f"SELECT * FROM t_tu_returns WHERE pos < {HOLDOUT}")
block("t_tu_folds", f"SELECT DISTINCT (pos - {TRAIN}) // {TEST} AS fold, (pos - {TRAIN}) // {TEST} * {TEST} + {TRAIN} AS s FROM t_tu_before WHERE pos >= {TRAIN}")
_IR = "avg(ret - benchmark_return) / nullif(stddev_samp(ret - benchmark_return), 0) * sqrt(12)"
block("t_tu_fold_best", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_score DESC NULLS LAST, config_id) AS k FROM (
 SELECT f.fold, f.s, c.config_id, {_IR} AS train_score FROM t_tu_folds f JOIN t_tu_before c ON c.pos >= f.s - {TRAIN} AND c.pos < f.s GROUP BY 1, 2, 3)) WHERE k = 1
""")
block("t_tu_in_sample", f"SELECT config_id, {_IR} AS objective, avg(turnover) AS avg_turnover FROM t_tu_before GROUP BY 1")
block("t_tu_best", "SELECT config_id FROM t_tu_in_sample WHERE objective IS NOT NULL ORDER BY objective DESC, config_id LIMIT 1")
block("t_tu_walked", f"""
SELECT 'tuned_walk_forward' AS series, c.pos, c.ret, c.benchmark_return FROM t_tu_fold_best b JOIN t_tu_before c ON c.config_id = b.config_id AND c.pos >= b.s AND c.pos < b.s + {TEST}
UNION ALL SELECT 'base_same_windows', pos, ret, benchmark_return FROM t_tu_before WHERE config_id = 'base' AND pos >= {TRAIN}
UNION ALL SELECT 'benchmark_same_windows', pos, benchmark_return, benchmark_return FROM t_tu_before WHERE config_id = 'base' AND pos >= {TRAIN}
""")
block("t_tu_kept", f"""
WITH h AS (SELECT * FROM t_tu_returns WHERE pos >= {HOLDOUT})
SELECT 'best_in_sample_config' AS series, pos, ret, benchmark_return FROM h WHERE config_id = (SELECT config_id FROM t_tu_best)
UNION ALL SELECT 'base', pos, ret, benchmark_return FROM h WHERE config_id = 'base'
UNION ALL SELECT 'benchmark', pos, benchmark_return, benchmark_return FROM h WHERE config_id = 'base'
""")
_STATS = ("log_growth", "cagr", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "cvar_95_daily", "downside_deviation", "hit_rate")


def stats_sql(source: str) -> str:
    """All twelve figures of a series."""
    return f"""
SELECT s.*, round(i.information_ratio, 5) AS information_ratio, round(i.active_return_annualized, 5) AS active_return_annualized FROM ({qp.perf_sql(source, 'series')}) s
JOIN (SELECT series, {_IR} AS information_ratio, avg(ret - benchmark_return) * 12 AS active_return_annualized FROM {source} GROUP BY 1) i USING (series)"""


# ---------------------------------------------------------------- Spark
def weights(spark, sf):
    def build():
        table = tu.configuration_table(spark, CONFIGS)
        scored = staged(spark, sf, "tuning_scores", lambda: tu.scored_sets(pl.snapshot(spark, sf), CONFIGS, cut_lineage))
        return tu.configured_weights(tu.configured_signals(scored, table))

    return staged(spark, sf, "tuning_weights", build)


def returns(spark, sf):
    def build():
        daily = po.attributed_returns(weights(spark, sf), tb.grid(spark, sf), qp.periods(spark, sf), ["config_id"], 8.0)
        daily = qp.with_benchmark(spark, sf, cut_lineage(daily))
        return daily.withColumn("pos", F.col("pos") - daily.select(F.min("pos")).scalar())

    return staged(spark, sf, "tuning_returns", build)


def report(spark, sf):
    return tu.tuning_report(returns(spark, sf), tu.configuration_table(spark, CONFIGS), HOLDOUT, TRAIN, TEST, PERIODS)


def stats(df):
    named = df.withColumn("cumulative_return", F.log1p("cumulative_return")).withColumnRenamed("cumulative_return", "log_growth")
    return rounded(named, 5)


@query("tuning_weights", "SELECT portfolio_id AS config_id, as_of_date, security_id, round(weight, 6) AS weight FROM t_tu_weights")
def _(spark, sf):
    return rounded(weights(spark, sf))


@query("tuning_returns", f"SELECT config_id, pos, {rnd('ret', 'turnover', 'benchmark_return')} FROM t_tu_returns")
def _(spark, sf):
    return rounded(returns(spark, sf).select("config_id", "pos", "ret", "turnover", "benchmark_return"))


_SETTINGS = ", ".join(f"('{c}', {_SETS[c][0]}, '{s.portfolio.weighting}')" for c, s in CONFIGS.items())


@query("tuning_grid", f"""
SELECT i.config_id, v.scoring_id, v.weighting, round(i.objective, 5) AS objective, round(i.avg_turnover, 5) AS avg_turnover, p.cagr AS pre_holdout_cagr, p.max_drawdown AS pre_holdout_max_drawdown,
  (SELECT count(*) FROM t_tu_fold_best b WHERE b.config_id = i.config_id) AS times_chosen_walk_forward
FROM t_tu_in_sample i JOIN (VALUES {_SETTINGS}) v(config_id, scoring_id, weighting) USING (config_id) JOIN ({qp.perf_sql('t_tu_before', 'config_id')}) p USING (config_id)""")
def _(spark, sf):
    return rounded(report(spark, sf)["grid"], 5)


@query("tuning_folds", f"""
SELECT b.fold, b.config_id, round(b.train_score, 6) AS train_score, b.s - {TRAIN} AS train_start, b.s - 1 AS train_end, b.s AS test_start,
  least(b.s + {TEST} - 1, (SELECT max(pos) FROM t_tu_before)) AS test_end FROM t_tu_fold_best b""")
def _(spark, sf):
    return rounded(report(spark, sf)["folds"])


@query("tuning_summary", stats_sql("t_tu_walked"))
def _(spark, sf):
    return stats(report(spark, sf)["walk_forward"])


@query("tuning_holdout", f"SELECT h.*, (SELECT config_id FROM t_tu_best) AS best_config_id FROM ({stats_sql('t_tu_kept')}) h")
def _(spark, sf):
    tables = report(spark, sf)
    return stats(tables["holdout"].withColumn("best_config_id", tables["best"].select("config_id").scalar()))
