"""Risk limits as constraints on the target weights of every decision date."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import enforcement as en, portfolio as po, risk as rk
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans import q_portfolio as qp
from quantloom.plans.oracle import block
from quantloom.plans.registry import query, rounded, staged

KEYS, LIMITS, SIZING = qp.KEYS, tb.STRATEGY.risk, tb.STRATEGY.portfolio

block("t_model_weights", """
SELECT b.*, s.sector_id, s.industry_id FROM (
  SELECT 'inverse_volatility' AS portfolio_id, as_of_date, security_id, weight FROM t_target
  UNION ALL SELECT 'equal_weight', as_of_date, security_id, equal_weight FROM t_raw_weights) b JOIN t_securities s USING (security_id)
""")
qp.risk_blocks("t_e_", "t_model_weights")
# A row for each book: names in order, and the whole covariance as a list of rows.
block("t_e_pairs", """
SELECT a.portfolio_id, a.as_of_date, a.security_id AS i, b.security_id AS j,
  CASE WHEN x.good AND y.good THEN c.c WHEN a.security_id = b.security_id THEN coalesce(m.med, 0.09::DOUBLE) ELSE 0 END AS c
FROM t_model_weights a JOIN t_model_weights b ON a.portfolio_id = b.portfolio_id AND a.as_of_date = b.as_of_date
LEFT JOIN t_e_names x ON x.portfolio_id = a.portfolio_id AND x.as_of_date = a.as_of_date AND x.security_id = a.security_id
LEFT JOIN t_e_names y ON y.portfolio_id = b.portfolio_id AND y.as_of_date = b.as_of_date AND y.security_id = b.security_id
LEFT JOIN t_e_cov c ON c.portfolio_id = a.portfolio_id AND c.as_of_date = a.as_of_date AND c.i = a.security_id AND c.j = b.security_id
LEFT JOIN (SELECT portfolio_id, as_of_date, quantile_cont(c, 0.5) AS med FROM t_e_cov WHERE i = j GROUP BY 1, 2) m ON m.portfolio_id = a.portfolio_id AND m.as_of_date = a.as_of_date
""")
block("t_e_books", """
SELECT w.*, k.cov, coalesce(d.days, 0) AS days FROM (
  SELECT portfolio_id, as_of_date, list(security_id ORDER BY security_id) AS ids, list(weight ORDER BY security_id) AS w0, sum(weight) AS budget, count(*) AS n,
    list(sector_id ORDER BY security_id) AS sec, list(industry_id ORDER BY security_id) AS ind FROM t_model_weights GROUP BY 1, 2) w
JOIN (SELECT portfolio_id, as_of_date, list(r ORDER BY i) AS cov FROM (SELECT portfolio_id, as_of_date, i, list(c ORDER BY j) AS r FROM t_e_pairs GROUP BY 1, 2, 3) GROUP BY 1, 2) k USING (portfolio_id, as_of_date)
LEFT JOIN (SELECT portfolio_id, as_of_date, count(DISTINCT date) AS days FROM t_e_window GROUP BY 1, 2) d USING (portfolio_id, as_of_date)
""")


def _sums(values: str, groups: str) -> str:
    """The sum of each name's group, name by name."""
    return (f"list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(1, n + 1), lambda j: CASE WHEN {groups}[j] = {groups}[i] THEN {values}[j] ELSE 0::DOUBLE END)))")


# One pass of one cap a step. stage: 1 both caps, 2 risk budget, 3 done; kind: 0 sectors, 1 industries.
_RC = "list_transform(range(1, n + 1), lambda i: u[i] * list_dot_product(cov[i], u) / nullif(list_dot_product(u, list_transform(cov, lambda r: list_dot_product(r, u))), 0))"
block("t_e_steps", f"""
SELECT * FROM (WITH RECURSIVE steps AS (
  SELECT portfolio_id, as_of_date, 0 AS step, 1 AS stage, 0 AS kind, 1 AS round, list_transform(w0, lambda x: x / budget) AS base, list_transform(w0, lambda x: x / budget) AS w, FALSE AS moved, FALSE AS trimmed FROM t_e_books
  UNION ALL
  SELECT portfolio_id, as_of_date, step + 1,
    CASE WHEN NOT done THEN stage WHEN turn THEN stage WHEN trim THEN 2 ELSE 3 END,
    CASE WHEN NOT done THEN kind WHEN kind = 0 THEN 1 ELSE 0 END,
    CASE WHEN NOT done OR kind = 0 THEN round WHEN stage = 1 AND turn THEN round + 1 WHEN stage = 1 THEN 1 ELSE round + 1 END,
    CASE WHEN NOT done THEN base WHEN turn THEN list_transform(u, lambda x: x / list_sum(u)) WHEN trim THEN list_transform(cut, lambda x: x / list_sum(cut)) ELSE base END,
    CASE WHEN NOT done THEN nxt WHEN turn THEN list_transform(u, lambda x: x / list_sum(u)) WHEN trim THEN list_transform(cut, lambda x: x / list_sum(cut)) ELSE u END,
    CASE WHEN done AND stage = 1 AND NOT turn THEN list_sum(list_transform(range(1, n + 1), lambda i: abs(u[i] - w0[i]))) > 1e-6 ELSE moved END,
    trimmed OR (done AND NOT turn AND trim)
  FROM (
    SELECT *, done AND (kind = 0 OR (stage = 1 AND round < {en.CAP_TURNS} AND (
        list_max({_sums('u', 'sec')}) > {SIZING.max_sector_weight} * budget + 1e-9 OR list_max({_sums('u', 'ind')}) > {LIMITS.max_industry_weight} * budget + 1e-9))) AS turn,
      list_max(rc) > {LIMITS.max_single_name_risk_contribution} + 1e-6 AND n * {LIMITS.max_single_name_risk_contribution} >= 1 AND days > 0 AND (stage = 1 OR round <= {en.TRIMS - 1}) AS trim,
      list_transform(range(1, n + 1), lambda i: CASE WHEN rc[i] > {LIMITS.max_single_name_risk_contribution} + 1e-6 THEN u[i] * sqrt({LIMITS.max_single_name_risk_contribution} / rc[i]) ELSE u[i] END) AS cut
    FROM (SELECT *, {_RC} AS rc FROM (
      SELECT *, list_transform(v, lambda x: greatest(x, 0) * budget) AS u, CASE WHEN NOT done THEN list_transform(range(1, n + 1), lambda i: v[i] + gap * open[i] / room) END AS nxt
      FROM (SELECT *, NOT (gap > 1e-10 AND room > 0) AS done FROM (
        SELECT *, 1 - list_sum(v) AS gap, list_sum(open) AS room FROM (
          SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN {SIZING.max_position_weight} - v[i] > 1e-10 AND greatest(gcap - held[i], 0) > 1e-10 THEN base[i] ELSE 0 END) AS open FROM (
            SELECT *, {_sums('v', 'grp')} AS held FROM (
              SELECT *, list_transform(range(1, n + 1), lambda i: c[i] * least(1, gcap / sums[i])) AS v FROM (
                SELECT *, {_sums('c', 'grp')} AS sums FROM (
                  SELECT s.*, b.w0, b.budget, b.n, b.sec, b.ind, b.cov, b.days, list_transform(s.w, lambda x: least(x, {SIZING.max_position_weight}::DOUBLE)) AS c,
                    CASE WHEN s.kind = 0 THEN b.sec ELSE b.ind END AS grp, CASE WHEN s.kind = 0 THEN {SIZING.max_sector_weight}::DOUBLE ELSE {LIMITS.max_industry_weight}::DOUBLE END AS gcap
                  FROM steps s JOIN t_e_books b ON b.portfolio_id = s.portfolio_id AND b.as_of_date = s.as_of_date WHERE s.stage < 3))))))))))
) SELECT * FROM steps WHERE stage = 3)
""")
block("t_e_flat", "SELECT s.portfolio_id, s.as_of_date, unnest(b.ids) AS security_id, unnest(s.w) AS weight, unnest(b.w0) AS before FROM t_e_steps s JOIN t_e_books b USING (portfolio_id, as_of_date)")
block("t_e_beta", """
SELECT portfolio_id, as_of_date, CASE WHEN count(benchmark_return) > 20 THEN covar_samp(hist, benchmark_return) / nullif(var_samp(benchmark_return), 0) END AS beta
FROM (SELECT f.portfolio_id, f.as_of_date, x.date, sum(x.ret * f.weight) AS hist FROM t_e_flat f JOIN t_e_window x ON x.portfolio_id = f.portfolio_id AND x.as_of_date = f.as_of_date AND x.security_id = f.security_id GROUP BY 1, 2, 3) h
JOIN t_benchmark USING (date) GROUP BY 1, 2
""")
block("t_e_scaled", f"""
SELECT *, CASE WHEN days = 0 THEN 1 ELSE greatest(least(1, coalesce({LIMITS.max_portfolio_volatility} / nullif(greatest(vol, {LIMITS.max_portfolio_volatility}), 0), 1),
    coalesce({LIMITS.max_var_95_daily} / greatest(vol / sqrt(12) * {rk.Z_95!r}::DOUBLE, {LIMITS.max_var_95_daily}), 1), coalesce({LIMITS.max_beta} / greatest(beta, {LIMITS.max_beta}), 1)),
    least({LIMITS.min_gross_exposure} / budget, 1)) END AS scale
FROM (SELECT s.*, b.budget, b.days, sqrt(greatest(list_dot_product(s.w, list_transform(b.cov, lambda r: list_dot_product(r, s.w))), 0)) AS vol, t.beta
  FROM t_e_steps s JOIN t_e_books b USING (portfolio_id, as_of_date) LEFT JOIN t_e_beta t USING (portfolio_id, as_of_date))
""")


def model_weights(spark, sf):
    """Two books of each decision date: capped inverse volatility, and equal weights as they are."""
    columns = ["as_of_date", "security_id", "weight"]
    equal = po.equal_weight(qp.chosen(spark, sf), ["as_of_date"]).select(F.lit("equal_weight").alias("portfolio_id"), *columns)
    model = qp.target(spark, sf).select(F.lit("inverse_volatility").alias("portfolio_id"), *columns)
    return model.unionByName(equal).join(tb.securities(spark, sf).drop("ticker"), "security_id")


def enforced(spark, sf):
    def build():
        weights = staged(spark, sf, "model_weights", lambda: model_weights(spark, sf))
        window, index = qp.risk_inputs(spark, sf, weights)
        return en.enforced_limits(weights, window, index, KEYS, LIMITS, SIZING.max_position_weight, SIZING.max_sector_weight, periods=12)

    return staged(spark, sf, "enforced", build)


@query("enforced_weights", """
SELECT f.portfolio_id, f.as_of_date, f.security_id, round(f.before, 6) AS before, round(f.weight * s.scale, 6) AS weight
FROM t_e_flat f JOIN t_e_scaled s USING (portfolio_id, as_of_date) WHERE f.weight * s.scale > 1e-12""")
def _(spark, sf):
    return rounded(en.enforced_weights(enforced(spark, sf), KEYS).select(*KEYS, "security_id", "before", "weight"))


@query("enforcement_actions", f"""
SELECT portfolio_id, as_of_date, array_to_string(list_filter([CASE WHEN moved THEN '{en.CAPS_APPLIED}' END, CASE WHEN trimmed THEN '{en.TRIMMED}' END,
  CASE WHEN scale < 1 - 1e-9 THEN '{en.SCALED}' || CAST(round(100 * scale * list_sum(w)) AS INTEGER) || '%' END], lambda x: x IS NOT NULL), ',') AS actions FROM t_e_scaled""")
def _(spark, sf):
    return enforced(spark, sf).select(*KEYS, F.array_join("actions", ",").alias("actions"))
