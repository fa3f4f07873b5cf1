"""Factor research queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.config import FAMILIES, FEATURES
from quantloom.functions import ranking as rk
from quantloom.operators import crosssection as cs, research as rs
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans.candidates import CANDIDATES, SPLIT
from quantloom.plans.oracle import block, percentile_sql, spearman_sql
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.registry import query, rounded, staged

@query("forward_returns", "SELECT as_of_date, security_id, horizon::BIGINT AS horizon, round(forward_return, 6) AS forward_return, exit_date FROM t_forward")
def _(spark, sf):
    return rounded(pl.forward(spark, sf))


@query("holding_period_returns", "SELECT as_of_date, security_id, round(forward_return, 6) AS forward_return, exit_date FROM t_raw_forward")
def _(spark, sf):
    legs = pl.legs(spark, sf, (1,))
    return rounded(rs.forward_returns(tb.grid(spark, sf), legs, filled=False).drop("horizon"))


@query("research_percentiles", "SELECT as_of_date, security_id, factor, round(pct, 9) AS pct, factor_size, universe FROM t_panel")
def _(spark, sf):
    df = pl.panel_percentiles(spark, sf)
    return rounded(df.select("as_of_date", "security_id", "factor", "pct", "factor_size", "universe"), 9)


@query("information_coefficients", "SELECT as_of_date, factor, horizon::BIGINT AS horizon, round(ic, 6) AS ic FROM t_ic")
def _(spark, sf):
    return rounded(pl.panel_ic(spark, sf).select("as_of_date", "factor", "horizon", "ic"))


@query("quintile_returns", f"SELECT as_of_date, factor, {rnd('q1', 'q2', 'q3', 'q4', 'q5')} FROM t_quintiles")
def _(spark, sf):
    return rounded(pl.panel_quintiles(spark, sf))


@query("top_quintile_turnover", "SELECT as_of_date, factor, round(turnover, 6) AS turnover FROM t_turnover")
def _(spark, sf):
    return rounded(pl.panel_turnover(spark, sf))


@query("factor_coverage", "SELECT as_of_date, factor, round(any_value(factor_size) / CAST(any_value(universe) AS DOUBLE), 6) AS coverage FROM t_panel GROUP BY 1, 2")
def _(spark, sf):
    return rounded(pl.panel_coverage(spark, sf))


CORRELATED = tuple(name for name, _, _ in CANDIDATES)
block("t_corr", """
SELECT a.as_of_date, a.factor AS factor_a, b.factor AS factor_b,
  CASE WHEN min(a.pct) < max(a.pct) AND min(b.pct) < max(b.pct) THEN corr(a.pct, b.pct) END AS corr
FROM t_pct_ord a JOIN t_pct_ord b ON a.as_of_date = b.as_of_date AND a.security_id = b.security_id AND a.o <= b.o GROUP BY 1, 2, 3
""")
block("t_pct_ord", "SELECT p.*, o.o FROM t_panel p JOIN (VALUES " + ", ".join(
    f"('{f}', {i})" for i, f in enumerate(CORRELATED)) + ") o(factor, o) ON o.factor = p.factor")


def correlations(spark, sf):
    pct = pl.panel_percentiles(spark, sf)
    wide = rk.wide_form(pct, ["as_of_date", "security_id"], "factor", "pct", {f: f for f in CORRELATED})
    return rs.factor_correlations(wide, CORRELATED)


@query("factor_correlations", "SELECT as_of_date, factor_a, factor_b, round(corr, 6) AS corr FROM t_corr WHERE corr IS NOT NULL")
def _(spark, sf):
    return rounded(correlations(spark, sf).where("corr is not null"))


@query("mean_factor_correlations", "SELECT factor_a, factor_b, round(avg(corr), 6) AS corr FROM t_corr GROUP BY 1, 2")
def _(spark, sf):
    return rounded(rs.mean_correlations(correlations(spark, sf)))


@query("redundant_factor_pairs", """
SELECT factor_a, factor_b, round(c, 6) AS corr FROM (SELECT factor_a, factor_b, avg(corr) AS c FROM t_corr GROUP BY 1, 2)
WHERE factor_a <> factor_b AND abs(c) >= 0.5 ORDER BY abs(c) DESC""")
def _(spark, sf):
    return rounded(rs.pairs_above(rs.mean_correlations(correlations(spark, sf)), 0.5))


_SUMMARY = ("ic_ir", "hit_rate", "ic_first_half", "ic_second_half", "mean_ic_1m", "mean_ic_3m", "mean_ic_6m", "nw_t_1m", "nw_t_3m",
            "nw_t_6m", "q5_q1_annual", "top_excess_annual", "monotonicity", "q5_q1_nw_t", "top_quintile_turnover", "coverage")
for _part in ("research", "holdout"):

    @query(f"factor_summary_{_part}", f"SELECT factor, months, {rnd(*_SUMMARY)} FROM t_summary_{_part}")
    def _(spark, sf, part=_part):
        return rounded(pl.factor_summary(spark, sf, part).select("factor", "months", *_SUMMARY))


# Two-sided p of a normal statistic by Simpson's rule over its tail, ten deviations wide.
_TAIL = """sqrt(2 / pi()) * 0.005::DOUBLE / 3 * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(abs(nw_t_1m) + i * 0.005::DOUBLE, 2) / 2)))"""
block("t_p_values", f"SELECT *, CASE WHEN isfinite(nw_t_1m) THEN {_TAIL} END AS p_value FROM t_summary_research")
block("t_q_values", """
SELECT *, CASE WHEN p_value IS NOT NULL THEN least(min(raw) OVER (ORDER BY p_value IS NULL, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END AS q_value_bh
FROM (SELECT *, p_value * count(p_value) OVER () / k AS raw FROM (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST, factor) AS k FROM t_p_values))
""")


@query("factor_significance", "SELECT factor, round(nw_t_1m, 6) AS nw_t_1m, round(p_value, 6) AS p_value, round(q_value_bh, 6) AS q_value_bh FROM t_q_values")
def _(spark, sf):
    """p- and q-values, held against numerical integration."""
    ic = pl.panel_ic(spark, sf, (1,)).where(F.col("as_of_date") < SPLIT)
    return rounded(rs.significance(ic).select("factor", "nw_t_1m", "p_value", "q_value_bh"))


@query("benjamini_hochberg", """
WITH p AS (SELECT l_suppkey AS k, avg(l_discount) * 10 AS p FROM lineitem GROUP BY 1),
r AS (SELECT k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw, row_number() OVER (ORDER BY p, k) AS n FROM p)
SELECT k, round(least(min(raw) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r""".replace(
    "WITH p AS (SELECT l_suppkey AS k, avg(l_discount) * 10 AS p FROM lineitem GROUP BY 1)",
    "WITH p AS (SELECT l_returnflag || l_linestatus || l_linenumber AS k, avg(l_discount) * 10 AS p FROM lineitem GROUP BY 1)"))
def _(spark, sf):
    # A fixed family of tests: one per return flag, line status and line number.
    tests = tb.read(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("k")
    ).agg((F.avg("l_discount") * 10).alias("p"))
    return rounded(rs.benjamini_hochberg(tests, "p", "q").select("k", "q"))


_LISTED = ", ".join(f"('{n}', '{fam}', {up}, {n in FEATURES})" for n, up, fam in CANDIDATES)


@query("factor_verdicts", f"""
SELECT r.factor, c.family, c.higher_is_better, c.in_strategy, round(r.mean_ic_1m, 6) AS mean_ic_1m, round(r.nw_t_1m, 6) AS nw_t_1m, round(r.q_value_bh, 6) AS q_value_bh,
  coalesce(r.nw_t_1m > {rs.T_HURDLE}, FALSE) AS passes_t3, round(h.mean_ic_1m, 6) AS holdout_mean_ic_1m, round(h.nw_t_1m, 6) AS holdout_nw_t_1m,
  CASE WHEN NOT coalesce(r.q_value_bh < 0.10, FALSE) THEN 'NOT_SIGNIFICANT' WHEN NOT coalesce(r.mean_ic_1m > 0, FALSE) THEN 'INVERTED'
    WHEN coalesce(h.mean_ic_1m > 0 AND h.nw_t_1m >= {rs.HOLDOUT_T}, FALSE) THEN 'ACCEPT' ELSE 'FAILS_HOLDOUT' END AS verdict
FROM t_q_values r LEFT JOIN t_summary_holdout h ON h.factor = r.factor LEFT JOIN (VALUES {_LISTED}) c(factor, family, higher_is_better, in_strategy) ON c.factor = r.factor""")
def _(spark, sf):
    return rounded(rs.verdicts(pl.factor_summary(spark, sf, "research"), pl.factor_summary(spark, sf, "holdout"),
                               pl.candidates_table(spark)))


@query("ic_by_year", "SELECT factor, year(as_of_date) AS year, round(avg(ic), 6) AS ic FROM t_ic WHERE horizon = 1 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(rs.ic_by_year(pl.panel_ic(spark, sf, (1,))))


@query("research_slice", f"""
SELECT factor, count(*) FILTER (WHERE as_of_date < DATE '{SPLIT}') AS research_rows,
       count(*) FILTER (WHERE as_of_date >= DATE '{SPLIT}') AS holdout_rows FROM t_panel GROUP BY 1""")
def _(spark, sf):
    day = F.col("as_of_date")
    return pl.panel_percentiles(spark, sf).groupBy("factor").agg(
        F.count_if(day < SPLIT).alias("research_rows"), F.count_if(day >= SPLIT).alias("holdout_rows"))


COMPOSITE = ("mom_12_1", "earnings_yield", "roic", "high_52w_ratio")


@query("equal_weight_composite", "SELECT as_of_date, security_id, round(avg(pct), 9) AS research_composite FROM t_panel WHERE factor IN ("
       + ", ".join(f"'{c}'" for c in COMPOSITE) + ") GROUP BY 1, 2")
def _(spark, sf):
    return rounded(rs.equal_weight_composite(pl.panel_percentiles(spark, sf), COMPOSITE), 9)


# ---------------------------------------------------------------- score diagnostics (tuning)
_NAMES = ("composite", *FAMILIES)
block("t_score_forward", "SELECT s.*, f.forward_return FROM t_signals s JOIN t_raw_forward f USING (as_of_date, security_id) "
      "WHERE as_of_date IN (SELECT as_of_date FROM t_signals GROUP BY 1 HAVING count(*) >= 20)")
block("t_score_long", "\nUNION ALL\n".join(
    f"SELECT as_of_date, '{n}' AS factor, {n}_score AS score, forward_return FROM t_score_forward" for n in _NAMES))
block("t_score_ic", spearman_sql("t_score_long", "as_of_date, factor", "score", "forward_return", 20))


def score_forward(spark, sf):
    """Scores (no features) of the dates with enough names, and what each row returned."""
    signals = pl.signals(spark, sf).select("as_of_date", "security_id", "sector_id", *[f"{n}_score" for n in _NAMES])
    sizes = signals.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 20")
    fwd = rs.forward_returns(tb.grid(spark, sf), pl.legs(spark, sf, (1,)), filled=False)
    big = signals.join(F.broadcast(sizes), "as_of_date", "left_semi")
    return staged(spark, sf, "score_forward", lambda: big.join(fwd, ["as_of_date", "security_id"]))


def score_ic(spark, sf):
    long = rk.long_form(score_forward(spark, sf), ["as_of_date", "security_id", "forward_return"],
                        [f"{n}_score" for n in _NAMES], "factor", "score")
    long = long.withColumn("factor", F.regexp_replace("factor", "_score$", ""))
    return staged(spark, sf, "score_ic", lambda: rs.spearman(
        long, ["as_of_date", "factor"], "score", "forward_return", 20))


@query("score_information_coefficients", "SELECT as_of_date, factor, n, round(ic, 6) AS ic FROM t_score_ic")
def _(spark, sf):
    return rounded(score_ic(spark, sf))


@query("feature_information_coefficients", spearman_sql(
    "(SELECT p.*, f.forward_return FROM (" + percentile_sql("t_score_forward", FEATURES)
    + ") p JOIN t_raw_forward f USING (as_of_date, security_id))", "as_of_date, factor", "pct", "forward_return", 20).replace(
    "THEN corr(ra, rb) END AS ic", "THEN round(corr(ra, rb), 6) END AS ic"))
def _(spark, sf):
    base = score_forward(spark, sf)
    returns = base.select("as_of_date", "security_id", "forward_return")
    pct = staged(spark, sf, "score_feature_pct", lambda: cs.feature_percentiles(pl.with_features(spark, sf, base), FEATURES).join(
        returns, ["as_of_date", "security_id"]))
    return rounded(rs.spearman(pct, ["as_of_date", "factor"], "pct", "forward_return", 20))


@query("score_ic_summary", """
SELECT factor, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 6) AS t_stat,
  round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_positive, count(*) AS periods
FROM t_score_ic WHERE ic IS NOT NULL GROUP BY 1
UNION ALL
SELECT 'q5_minus_q1_annualized', round(avg(s) * 12, 6), round(avg(s) / stddev_samp(s) * sqrt(count(*)), 6),
  round(avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6), count(*)
FROM (SELECT as_of_date, avg(forward_return) FILTER (WHERE b = 4) - avg(forward_return) FILTER (WHERE b = 0) AS s FROM
  (SELECT as_of_date, forward_return, greatest(ceil((row_number() OVER (PARTITION BY as_of_date ORDER BY composite_score, security_id) - 1) * 5.0::DOUBLE
     / (count(*) OVER (PARTITION BY as_of_date) - 1)) - 1, 0) AS b FROM t_score_forward) GROUP BY 1) WHERE s IS NOT NULL""")
def _(spark, sf):
    ic = rs.ic_summary(score_ic(spark, sf), ["factor"])
    ranked = rk.first_rank(score_forward(spark, sf), ["as_of_date"], "composite_score", "security_id", "_r")
    quint = ranked.withColumn("bucket", rk.equal_count_bucket(F.col("_r"), F.col("_r_n")))
    spread = rs.quintile_returns(quint, ["as_of_date"], "forward_return").withColumn("spread", F.col("q5") - F.col("q1"))
    return rounded(ic.unionByName(rs.spread_summary(spread, "spread", 12, "q5_minus_q1_annualized")))


@query("score_ic_by_year", "SELECT factor, year(as_of_date) AS year, round(avg(ic), 6) AS ic FROM t_score_ic GROUP BY 1, 2")
def _(spark, sf):
    return rounded(rs.ic_by_year(score_ic(spark, sf)))
