"""Building blocks of the checking SQL.

Each entry is one common table expression over the given tables, written independently of the
Spark plans (direct range joins, plain windows, built-in quantiles). :func:`with_tables`
collects the blocks a statement needs.
"""

from __future__ import annotations

import re

from quantloom.config import FAMILY_FEATURES, FEATURES, FAMILIES
from quantloom.plans.testbed import STRATEGY

BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text.strip()


def with_tables(select: str) -> str:
    """``WITH`` clause of every block that ``select`` mentions, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bt_[a-z0-9_]+\b", text)):
            if word in BLOCKS and word not in needed:
                visit(BLOCKS[word])
                if word not in needed:
                    needed.append(word)

    visit(select)
    if not needed:
        return select
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{BLOCKS[n]}\n)" for n in needed)
    own = select.lstrip()
    if own.upper().startswith("WITH "):
        return f"WITH {parts},\n{own[5:]}"
    return f"WITH {parts}\n{select}"


block("t_securities", """
SELECT s_suppkey AS security_id, s_name AS ticker, r_name AS sector_id, n_name AS industry_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
block("t_lines", """
SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS day,
       last_day(CAST(l_shipdate AS DATE)) AS date, l_quantity AS qty, l_extendedprice AS gross,
       l_extendedprice * (1 - l_discount) AS net, l_discount, l_tax, l_returnflag
FROM lineitem
""")
block("t_bars", """
SELECT b.security_id, b.date, f.open, b.high, b.low, b.net_units / 10000.0::DOUBLE / b.volume AS close,
       b.gross_units / 100.0::DOUBLE / b.volume AS price_close, b.volume
FROM (SELECT security_id, date, sum(qty) AS volume,
             CAST(sum(CAST(round(gross * 100) AS BIGINT)) AS DOUBLE) AS gross_units,
             CAST(sum(CAST(round(net * 10000) AS BIGINT)) AS DOUBLE) AS net_units,
             max(net / qty) AS high, min(net / qty) AS low, min(day) AS first_day
      FROM t_lines GROUP BY 1, 2) b
JOIN (SELECT security_id, date, day, min(net / qty) AS open FROM t_lines GROUP BY 1, 2, 3) f
  ON f.security_id = b.security_id AND f.date = b.date AND f.day = b.first_day
""")
block("t_calendar", """
SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos
FROM (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date FROM lineitem)
""")
block("t_prices", "SELECT b.*, c.pos FROM t_bars b JOIN t_calendar c USING (date)")
block("t_grid", """
SELECT s.security_id, c.date, c.pos, b.open, b.high, b.low, b.close, b.price_close, b.volume
FROM t_securities s CROSS JOIN t_calendar c
LEFT JOIN t_bars b ON b.security_id = s.security_id AND b.date = c.date
""")
block("t_returns", """
SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close) - ln(lag(close) OVER w) AS log_ret
FROM t_grid WINDOW w AS (PARTITION BY security_id ORDER BY pos)
""")
block("t_benchmark", "SELECT date, avg(ret) AS benchmark_return FROM t_returns GROUP BY date")
block("t_price_features", """
SELECT security_id, date AS as_of_date, pos, price_close AS price,
       avg(price_close * volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS adv_usd,
       stddev_samp(log_ret) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) * sqrt(12) AS volatility_63d,
       lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS mom_12_1,
       close / lag(close, 6) OVER w - 1 AS mom_6m,
       close / lag(close, 3) OVER w - 1 AS mom_3m,
       close / lag(close, 1) OVER w - 1 AS ret_1m,
       CASE WHEN enough THEN stddev_samp(ret) OVER y * sqrt(12) END AS volatility_252d,
       CASE WHEN enough AND n_b >= 6 AND var_b > 0 THEN (s_rb - s_r * s_b / n_b) / var_b END AS beta_252d,
       CASE WHEN enough THEN close / max(close) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) END AS high_52w_ratio
FROM (SELECT *, s_bb - s_b * s_b / n_b AS var_b,
             CASE WHEN pos > 0 THEN n_r / least(pos, 12) >= 0.8 END AS enough
      FROM (SELECT r.*, count(ret) OVER y AS n_r, count(b) OVER y AS n_b, sum(b) OVER y AS s_b,
                   sum(b * b) OVER y AS s_bb,
                   sum(CASE WHEN b IS NOT NULL THEN coalesce(ret, 0) END) OVER y AS s_r,
                   sum(CASE WHEN b IS NOT NULL THEN coalesce(ret, 0) END * b) OVER y AS s_rb
            FROM (SELECT t_returns.*, benchmark_return AS b FROM t_returns JOIN t_benchmark USING (date)) r
            WINDOW y AS (PARTITION BY security_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)))
WINDOW w AS (PARTITION BY security_id ORDER BY pos),
       y AS (PARTITION BY security_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
_M = {
    "revenue": "net",
    "gross_profit": "net - 0.6::DOUBLE * gross",
    "ebitda": "net - 0.65::DOUBLE * gross - gross * l_tax",
    "net_income": "net - 0.75::DOUBLE * gross - gross * l_tax",
    "free_cash_flow": "CASE WHEN l_returnflag = 'R' THEN -(gross * l_tax) ELSE net - 0.7::DOUBLE * gross END",
    "invested_capital": "2 * gross",
    "net_debt": "gross * l_discount - gross * l_tax",
}
_sums = ",\n       ".join(
    f"CAST(sum(CAST(round(({x}) * 10000) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS {n}" for n, x in _M.items()
)
block("t_fundamentals", f"""
SELECT security_id, event_time, event_time + CAST(25 + security_id % 35 AS INTEGER) AS available_at,
       event_time + CAST(26 + security_id % 35 AS INTEGER) AS ingested_at, {", ".join(_M)}
FROM (SELECT security_id, last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) AS event_time,
       {_sums}
FROM t_lines GROUP BY 1, 2)
""")
block("t_shares", """
SELECT security_id, quarter_end + 20 AS available_at, qty + 500.0::DOUBLE AS shares_outstanding
FROM (SELECT security_id, last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) AS quarter_end,
             sum(qty) AS qty FROM t_lines GROUP BY 1, 2)
""")
block("t_estimates", """
SELECT security_id, date AS event_time, date - 3 AS available_at,
       CAST(sum(CAST(round(net * 10000) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE / count(*) AS fy1_eps_estimate,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n_revisions_up,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_revisions_down
FROM t_lines GROUP BY 1, 2
""")
block("t_composition", """
SELECT date, security_id FROM t_lines GROUP BY 1, 2 HAVING sum(qty) >= 60
""")
block("t_membership", """
SELECT security_id, CASE WHEN min(idx) > 0 THEN min(date) END AS start_date,
       max(idx) AS last_idx
FROM (SELECT c.security_id, s.date, s.idx, s.next_date,
             s.idx - row_number() OVER (PARTITION BY c.security_id ORDER BY s.idx) AS island
      FROM t_composition c JOIN t_snapshots s USING (date))
GROUP BY security_id, island
""")
block("t_snapshots", """
SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, lead(date) OVER (ORDER BY date) AS next_date
FROM (SELECT DISTINCT date FROM t_composition)
""")
block("t_members", """
SELECT security_id, start_date,
       CASE WHEN last_idx < (SELECT max(idx) FROM t_snapshots) THEN
            (SELECT s.date FROM t_snapshots s WHERE s.idx = m.last_idx + 1) END AS end_date
FROM t_membership m
""")
block("t_member_days", """
SELECT DISTINCT c.date AS as_of_date, m.security_id FROM t_calendar c JOIN t_members m
  ON (m.start_date IS NULL OR m.start_date <= c.date) AND (m.end_date IS NULL OR m.end_date > c.date)
""")
_flow = ",\n       ".join(
    f"CASE WHEN count(CASE WHEN age <= 300 THEN {c} END) >= 4 THEN sum(CASE WHEN age <= 300 THEN {c} END) END AS ttm_{c}"
    for c in ("revenue", "gross_profit", "ebitda", "net_income", "free_cash_flow")
)
block("t_visible_quarters", """
SELECT c.date AS as_of_date, f.*, date_diff('day', f.event_time,
         max(f.event_time) OVER (PARTITION BY c.date, f.security_id)) AS age
FROM t_calendar c JOIN t_fundamentals f ON f.available_at <= c.date
""")
block("t_ttm", f"""
SELECT as_of_date, security_id, {_flow},
       max(CASE WHEN age = 0 THEN net_debt END) AS net_debt,
       max(CASE WHEN age = 0 THEN invested_capital END) AS invested_capital,
       max(CASE WHEN age = 0 THEN revenue END) AS latest_revenue,
       max(CASE WHEN age = 0 THEN net_income END) AS latest_net_income,
       arg_max(revenue, event_time) FILTER (WHERE age BETWEEN 330 AND 400) AS prev_revenue,
       arg_max(net_income, event_time) FILTER (WHERE age BETWEEN 330 AND 400) AS prev_net_income,
       arg_max(invested_capital, event_time) FILTER (WHERE age BETWEEN 330 AND 400) AS prev_invested_capital,
       CASE WHEN count(*) FILTER (WHERE age <= 650) >= 6 THEN
         stddev_samp(CASE WHEN revenue > 0 THEN gross_profit / revenue END) FILTER (WHERE age <= 650) END AS gross_margin_volatility,
       CASE WHEN count(*) FILTER (WHERE age <= 650) >= 6 THEN
         stddev_samp(CASE WHEN revenue > 0 THEN net_income / revenue END) FILTER (WHERE age <= 650) END AS earnings_volatility,
       max(CASE WHEN age = 0 THEN available_at END) AS fundamentals_available_at
FROM t_visible_quarters GROUP BY 1, 2 HAVING count(*) FILTER (WHERE age <= 300) = 4
""")


def latest(table: str, value: str, days: int, name: str) -> str:
    return (
        f"(SELECT x.{value} FROM {table} x WHERE x.security_id = p.security_id "
        f"AND x.available_at <= p.as_of_date - {days} ORDER BY x.available_at DESC, x.{value} DESC LIMIT 1) AS {name}"
    )


block("t_asof", f"""
SELECT p.as_of_date, p.security_id,
       {latest("t_shares", "shares_outstanding", 0, "shares_now")},
       {latest("t_shares", "shares_outstanding", 365, "shares_then")},
       {latest("t_estimates", "fy1_eps_estimate", 0, "eps_now")},
       {latest("t_estimates", "fy1_eps_estimate", 30, "eps_30")},
       {latest("t_estimates", "fy1_eps_estimate", 90, "eps_90")},
       {latest("t_estimates", "available_at", 0, "estimates_available_at")},
       (SELECT sum(x.n_revisions_up) FROM t_estimates x WHERE x.security_id = p.security_id
         AND x.available_at <= p.as_of_date AND x.available_at > p.as_of_date - 30) AS n_up,
       (SELECT sum(x.n_revisions_down) FROM t_estimates x WHERE x.security_id = p.security_id
         AND x.available_at <= p.as_of_date AND x.available_at > p.as_of_date - 30) AS n_down
FROM t_price_features p
""")
block("t_features", """
SELECT p.*, s.ticker, s.sector_id, s.industry_id, a.shares_now AS shares_outstanding,
       p.price * a.shares_now AS market_cap_usd,
       CASE WHEN p.price * a.shares_now > 0 THEN ln(p.price * a.shares_now) END AS log_market_cap,
       a.shares_now / CASE WHEN a.shares_then > 0 THEN a.shares_then END - 1 AS net_issuance_1y,
       m.security_id IS NOT NULL AS in_universe,
       t.ttm_net_income / nullif(p.price * a.shares_now, 0) AS earnings_yield,
       t.ttm_free_cash_flow / nullif(p.price * a.shares_now, 0) AS fcf_yield,
       (p.price * a.shares_now + t.net_debt) / CASE WHEN t.ttm_ebitda > 0 THEN t.ttm_ebitda END AS ev_ebitda,
       t.ttm_net_income / CASE WHEN t.invested_capital > 0 THEN t.invested_capital END AS roic,
       t.ttm_gross_profit / CASE WHEN t.ttm_revenue > 0 THEN t.ttm_revenue END AS gross_margin,
       t.ttm_free_cash_flow / CASE WHEN t.ttm_revenue > 0 THEN t.ttm_revenue END AS fcf_margin,
       t.net_debt / CASE WHEN t.ttm_ebitda > 0 THEN t.ttm_ebitda END AS net_debt_ebitda,
       t.latest_revenue / CASE WHEN t.prev_revenue > 0 THEN t.prev_revenue END - 1 AS revenue_growth,
       t.latest_net_income / CASE WHEN t.prev_net_income > 0 THEN t.prev_net_income END - 1 AS eps_growth,
       t.ttm_revenue / nullif(p.price * a.shares_now, 0) AS sales_yield,
       t.ttm_gross_profit / CASE WHEN t.invested_capital > 0 THEN t.invested_capital END AS gross_profitability,
       (t.ttm_net_income - t.ttm_free_cash_flow) / CASE WHEN t.invested_capital > 0 THEN t.invested_capital END AS accruals,
       t.invested_capital / CASE WHEN t.prev_invested_capital > 0 THEN t.prev_invested_capital END - 1 AS asset_growth,
       t.gross_margin_volatility, t.earnings_volatility, t.fundamentals_available_at,
       a.eps_now / nullif(a.eps_30, 0) - 1 AS eps_rev_30d,
       a.eps_now / nullif(a.eps_90, 0) - 1 AS eps_rev_90d,
       CASE WHEN a.estimates_available_at IS NOT NULL THEN
         CAST(n_up AS DOUBLE) / nullif(CAST(n_up + n_down AS DOUBLE), 0) END AS revisions_up_ratio,
       a.estimates_available_at
FROM t_price_features p JOIN t_asof a USING (as_of_date, security_id)
JOIN t_securities s USING (security_id)
LEFT JOIN t_ttm t USING (as_of_date, security_id)
LEFT JOIN t_member_days m ON m.as_of_date = p.as_of_date AND m.security_id = p.security_id
""")
_e = STRATEGY.eligibility
_checks = (
    f"CASE WHEN price >= {_e.minimum_stock_price_usd} THEN NULL ELSE 'PRICE_BELOW_MIN' END",
    f"CASE WHEN market_cap_usd >= {_e.min_market_cap_usd} THEN NULL ELSE 'MARKET_CAP_BELOW_MIN' END",
    f"CASE WHEN adv_usd >= {_e.min_adv_usd} THEN NULL ELSE 'ADV_BELOW_MIN' END",
    "CASE WHEN sector_id IS NULL THEN 'MISSING_SECTOR' END",
    "CASE WHEN in_universe THEN NULL ELSE 'NOT_IN_UNIVERSE' END",
)
block("t_screened", f"""
SELECT *, concat_ws(',', {", ".join(_checks)}) AS reasons FROM t_features
""")
block("t_eligible", "SELECT * FROM t_screened WHERE reasons = ''")


def percentile_sql(source: str, features: dict[str, bool], date: str = "as_of_date") -> str:
    """Long winsorised sector percentiles of the listed columns of ``source``."""
    long = "\nUNION ALL\n".join(
        f"SELECT {date}, security_id, sector_id, '{f}' AS factor, {f}::DOUBLE AS v, {'1' if up else '-1'} AS sgn "
        f"FROM {source} WHERE {f} IS NOT NULL"
        for f, up in features.items()
    )
    return f"""
SELECT {date}, security_id, factor,
       CASE WHEN sector_id IS NOT NULL AND n_s >= 5 THEN (r_s + (k_s - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n_s
            ELSE (r_u + (k_u - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n_u END AS pct
FROM (SELECT *, rank() OVER (PARTITION BY {date}, factor ORDER BY x) AS r_u,
             count(*) OVER (PARTITION BY {date}, factor, x) AS k_u,
             count(*) OVER (PARTITION BY {date}, factor) AS n_u,
             rank() OVER (PARTITION BY {date}, factor, sector_id ORDER BY x) AS r_s,
             count(*) OVER (PARTITION BY {date}, factor, sector_id, x) AS k_s,
             count(*) OVER (PARTITION BY {date}, factor, sector_id) AS n_s
      FROM (SELECT *, sgn * least(greatest(v, lo), hi) AS x
            FROM (SELECT l.*, q.lo, q.hi FROM ({long}) l JOIN
                   (SELECT {date}, factor, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
                    FROM ({long}) GROUP BY 1, 2) q USING ({date}, factor))))
"""


def percentile_of(value: str, partition: str) -> str:
    """``(average rank - 0.5) / count`` of a column inside a partition, null for null."""
    part = f"PARTITION BY {partition}, {value} IS NULL"
    return (
        f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {value}) + "
        f"(count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) "
        f"/ count({value}) OVER (PARTITION BY {partition}) END"
    )


block("t_pct", percentile_sql("t_eligible", FEATURES))
_wide = ", ".join(f"max(CASE WHEN factor = '{f}' THEN pct END) AS pct_{f}" for f in FEATURES)
block("t_pct_wide", f"SELECT as_of_date, security_id, {_wide} FROM t_pct GROUP BY 1, 2")


def _family(members: dict[str, bool]) -> tuple[str, str]:
    n = " + ".join(f"CASE WHEN pct_{f} IS NULL THEN 0 ELSE 1 END" for f in members)
    total = " + ".join(["0.0::DOUBLE", *[f"coalesce(pct_{f}, 0)" for f in members]])
    return f"({n})", f"({total})"


_fam = []
for _f, _members in FAMILY_FEATURES.items():
    _n, _t = _family(_members)
    _fam.append(
        f"CASE WHEN {_n} / {len(_members)}.0::DOUBLE >= 0.5 AND {_n} > 0 THEN 100.0::DOUBLE * ({_t} / {_n}) END AS {_f}_score"
    )
block("t_families", f"""
SELECT e.*, {", ".join(f"w.pct_{f}" for f in FEATURES)}, {", ".join(_fam)}
FROM t_eligible e LEFT JOIN t_pct_wide w USING (as_of_date, security_id)
""")


def composite_sql(w: dict[str, float], source: str = "t_families") -> str:
    """Composite scores under the weights ``w``."""
    cov = " + ".join(["0.0::DOUBLE", *[f"CASE WHEN {f}_score IS NULL THEN 0.0::DOUBLE ELSE {w[f]}::DOUBLE END" for f in FAMILIES]])
    total = " + ".join(["0.0::DOUBLE", *[f"coalesce({f}_score, 0) * {w[f]}::DOUBLE" for f in FAMILIES]])
    return f"""
SELECT *, CASE WHEN data_coverage >= 0.7 - 1e-12 AND data_coverage > 0
               THEN least(greatest(weighted / data_coverage, 0), 100) END AS composite_score
FROM (SELECT *, {cov} AS data_coverage, {total} AS weighted FROM {source})
"""


block("t_composite", composite_sql(STRATEGY.composite_weights))
_pcts = ", ".join(
    f"{percentile_of(f'{n}_score', 'as_of_date')} AS {n}_percentile" for n in ("composite", *FAMILIES)
)
block("t_scored", f"""
SELECT *, CASE WHEN vol_pct > {_e.max_volatility_percentile} THEN 1 ELSE 0 END AS risk_flag
FROM (SELECT *, {_pcts}, {percentile_of("adv_usd", "as_of_date")} AS liquidity_percentile,
             {percentile_of("volatility_63d", "as_of_date")} AS vol_pct
      FROM t_composite WHERE composite_score IS NOT NULL)
""")


def _gate(family: str, least: float) -> str:
    return (
        f"(count({family}_percentile) OVER (PARTITION BY as_of_date) = 0 "
        f"OR coalesce({family}_percentile, 0) >= {least})"
    )


def labels_sql(s, source: str = "t_scored") -> str:
    """Decisions under the thresholds ``s``."""
    return f"""
SELECT *, CASE WHEN buy AND coalesce(composite_percentile, 0) >= {s.strong_long_composite_percentile} THEN 'STRONG_LONG'
  WHEN buy THEN 'LONG'
  WHEN composite_percentile <= {s.avoid_composite_percentile} OR risk_flag = 1 THEN 'AVOID'
  WHEN composite_percentile <= {s.reduce_composite_percentile}
       OR coalesce(revisions_percentile <= {s.reduce_revisions_percentile}, FALSE) THEN 'REDUCE'
  WHEN composite_percentile >= {s.watch_composite_percentile} THEN 'WATCH' ELSE 'NEUTRAL' END AS decision
FROM (SELECT *, composite_percentile >= {s.long_composite_percentile}
             AND {_gate("profitability", s.long_min_profitability_percentile)}
             AND {_gate("momentum", s.long_min_momentum_percentile)}
             AND {_gate("revisions", s.long_min_revisions_percentile)}
             AND coalesce(liquidity_percentile, 0) >= {s.long_min_liquidity_percentile}
             AND risk_flag = 0 AS buy FROM {source})
"""


block("t_signals", labels_sql(STRATEGY.signals))
block("t_price_named", "SELECT p.*, s.sector_id FROM t_price_features p JOIN t_securities s USING (security_id)")

# ---------------------------------------------------------------- research
from quantloom.plans.candidates import CANDIDATES, SPLIT  # noqa: E402

block("t_universe_size", "SELECT as_of_date, count(*) AS universe FROM t_eligible GROUP BY 1")
block("t_legs", """
SELECT c.date AS as_of_date, h.horizon, c.pos + 1 AS entry_pos, e.pos + 1 AS exit_pos, x.date AS exit_date
FROM t_calendar c CROSS JOIN (VALUES (1), (3), (6)) h(horizon)
JOIN t_calendar e ON e.pos = c.pos + h.horizon JOIN t_calendar x ON x.pos = e.pos + 1
""")
block("t_filled", """
SELECT security_id, pos, open, last_value(open IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t_grid
""")
block("t_forward", """
SELECT l.as_of_date, a.security_id, l.horizon, b.filled / a.open - 1 AS forward_return, l.exit_date
FROM t_legs l JOIN t_filled a ON a.pos = l.entry_pos JOIN t_filled b ON b.pos = l.exit_pos AND b.security_id = a.security_id
""")
block("t_raw_forward", """
SELECT l.as_of_date, a.security_id, b.open / a.open - 1 AS forward_return, l.exit_date
FROM t_legs l JOIN t_grid a ON a.pos = l.entry_pos JOIN t_grid b ON b.pos = l.exit_pos AND b.security_id = a.security_id
WHERE l.horizon = 1
""")
block("t_cand_pct", percentile_sql("t_eligible", {n: up for n, up, _ in CANDIDATES}))
block("t_panel", """
SELECT p.*, g.factor_size, u.universe FROM t_cand_pct p
JOIN (SELECT as_of_date, factor, count(*) AS factor_size FROM t_cand_pct GROUP BY 1, 2
      HAVING count(*) >= 30 AND count(DISTINCT pct) >= 5) g USING (as_of_date, factor)
JOIN t_universe_size u USING (as_of_date)
WHERE u.universe >= 30 AND as_of_date IN (SELECT as_of_date FROM t_legs WHERE horizon = 1)
""")


def spearman_sql(source: str, groups: str, a: str, b: str, minimum: int) -> str:
    return f"""
SELECT {groups}, count(*) AS n, CASE WHEN count(*) >= {minimum} AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS ic
FROM (SELECT {groups}, rank() OVER (PARTITION BY {groups} ORDER BY {a}) + (count(*) OVER (PARTITION BY {groups}, {a}) - 1) / 2.0::DOUBLE AS ra,
             rank() OVER (PARTITION BY {groups} ORDER BY {b}) + (count(*) OVER (PARTITION BY {groups}, {b}) - 1) / 2.0::DOUBLE AS rb
      FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY ALL"""


block("t_panel_forward", "SELECT p.*, f.horizon, f.forward_return FROM t_panel p JOIN t_forward f USING (as_of_date, security_id)")
block("t_ic_known", spearman_sql("t_panel_forward", "as_of_date, factor, horizon", "pct", "forward_return", 30))
block("t_ic", """
SELECT g.as_of_date, g.factor, h.horizon, i.ic FROM (SELECT DISTINCT as_of_date, factor FROM t_panel) g
CROSS JOIN (VALUES (1), (3), (6)) h(horizon) LEFT JOIN t_ic_known i USING (as_of_date, factor, horizon)
""")
block("t_buckets", """
SELECT as_of_date, factor, security_id, forward_return, greatest(ceil((r - 1) * 5.0::DOUBLE / (n - 1)) - 1, 0) AS bucket
FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, factor ORDER BY pct, security_id) AS r,
             count(*) OVER (PARTITION BY as_of_date, factor) AS n
      FROM t_panel_forward WHERE horizon = 1 AND forward_return IS NOT NULL) WHERE n >= 50
""")
_q = ", ".join(f"avg(forward_return) FILTER (WHERE bucket = {i}) - avg(forward_return) AS q{i + 1}" for i in range(5))
block("t_quintiles", f"SELECT as_of_date, factor, {_q} FROM t_buckets GROUP BY 1, 2")
block("t_bucket_dates", """
SELECT as_of_date, factor, row_number() OVER (PARTITION BY factor ORDER BY as_of_date) AS i
FROM (SELECT DISTINCT as_of_date, factor FROM t_buckets)
""")
block("t_top", "SELECT b.*, d.i FROM t_buckets b JOIN t_bucket_dates d USING (as_of_date, factor) WHERE bucket = 4")
block("t_turnover", """
SELECT d.as_of_date, d.factor, 1 - (SELECT count(*) FROM t_top a JOIN t_top b ON a.factor = b.factor AND a.security_id = b.security_id
         AND a.i = d.i AND b.i = d.i - 1 WHERE a.factor = d.factor)
       / CAST((SELECT count(*) FROM t_top b WHERE b.factor = d.factor AND b.i = d.i - 1) AS DOUBLE) AS turnover
FROM t_bucket_dates d WHERE d.i > 1
""")


def newey_west_sql(source: str, key: str, value: str, lags: int) -> str:
    terms = " ".join(
        f"+ {2.0 * (1.0 - k / (lags + 1))}::DOUBLE * coalesce(sum(e * e{k}), 0) / count(*)" for k in range(1, lags + 1)
    )
    shifted = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {key} ORDER BY as_of_date) AS e{k}" for k in range(1, lags + 1))
    return f"""(SELECT {key}, CASE WHEN n >= 3 AND v > 0 THEN m / sqrt(v / n) END AS t FROM
 (SELECT {key}, count(*) AS n, avg(x) AS m, sum(e * e) / count(*) {terms} AS v FROM
  (SELECT {key}, x, e, {shifted} FROM
   (SELECT {key}, as_of_date, {value} AS x, {value} - avg({value}) OVER (PARTITION BY {key}) AS e FROM {source} WHERE {value} IS NOT NULL)) GROUP BY {key}))"""


for _part, _cond in (("research", f"as_of_date < DATE '{SPLIT}'"), ("holdout", f"as_of_date >= DATE '{SPLIT}'")):
    block(f"t_ic_{_part}", f"SELECT * FROM t_ic WHERE {_cond}")
    for _h in (1, 3, 6):
        block(f"t_ic_{_part}_{_h}", f"SELECT * FROM t_ic_{_part} WHERE horizon = {_h}")
    block(f"t_spread_{_part}", f"SELECT *, q5 - q1 AS spread FROM t_quintiles WHERE {_cond}")
    _nw = " ".join(
        f"LEFT JOIN {newey_west_sql(f't_ic_{_part}_{h}', 'factor', 'ic', h)} w{h} ON w{h}.factor = b.factor" for h in (1, 3, 6)
    )
    _mono_ranks = ", ".join(
        f"({' + '.join(f'CASE WHEN m{j} < m{i} THEN 1.0::DOUBLE WHEN m{j} = m{i} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END' for j in range(1, 6))} + 0.5::DOUBLE) AS k{i}"
        for i in range(1, 6)
    )
    block(f"t_mono_{_part}", f"""
SELECT factor, s12 AS q5_q1_annual, t12 AS top_excess_annual,
  (k1 * -2 + k2 * -1 + k4 + k5 * 2) / sqrt(10 * ((k1-3)*(k1-3) + (k2-3)*(k2-3) + (k3-3)*(k3-3) + (k4-3)*(k4-3) + (k5-3)*(k5-3))) AS monotonicity
FROM (SELECT factor, s12, t12, {_mono_ranks} FROM (SELECT factor, avg(spread) * 12 AS s12, avg(q5) * 12 AS t12,
   avg(q1) AS m1, avg(q2) AS m2, avg(q3) AS m3, avg(q4) AS m4, avg(q5) AS m5 FROM t_spread_{_part} GROUP BY 1))""")
    block(f"t_summary_{_part}", f"""
SELECT b.*, (SELECT avg(ic) FROM t_ic_{_part}_1 x WHERE x.factor = b.factor) AS mean_ic_1m,
  (SELECT avg(ic) FROM t_ic_{_part}_3 x WHERE x.factor = b.factor) AS mean_ic_3m,
  (SELECT avg(ic) FROM t_ic_{_part}_6 x WHERE x.factor = b.factor) AS mean_ic_6m,
  w1.t AS nw_t_1m, w3.t AS nw_t_3m, w6.t AS nw_t_6m, m.q5_q1_annual, m.top_excess_annual, m.monotonicity, ws.t AS q5_q1_nw_t,
  (SELECT avg(turnover) FROM t_turnover t WHERE t.factor = b.factor AND {_cond}) AS top_quintile_turnover,
  (SELECT avg(c) FROM (SELECT as_of_date, any_value(factor_size) / CAST(any_value(universe) AS DOUBLE) AS c FROM t_panel p
     WHERE p.factor = b.factor AND {_cond} GROUP BY 1)) AS coverage
FROM (SELECT factor, count(*) AS months, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(12) END AS ic_ir,
             avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate,
             avg(ic) FILTER (WHERE r <= n // 2) AS ic_first_half, avg(ic) FILTER (WHERE r > n // 2) AS ic_second_half
      FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY as_of_date) AS r, count(*) OVER (PARTITION BY factor) AS n
            FROM t_ic_{_part}_1 WHERE ic IS NOT NULL) GROUP BY 1 HAVING count(*) >= 6) b
{_nw}
LEFT JOIN t_mono_{_part} m ON m.factor = b.factor
LEFT JOIN {newey_west_sql(f't_spread_{_part}', 'factor', 'spread', 1)} ws ON ws.factor = b.factor""")
