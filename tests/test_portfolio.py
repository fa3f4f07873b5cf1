"""Weights, rebalance plans, risk, research statistics, performance."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.config import FAMILIES, Sizing, Strategy, Thresholds, apply_overrides, configuration_grid
from quantloom.operators import crosssection as cs, performance as pf, portfolio as po, research as rs, risk as rk


CAPS = dict(max_position=0.08, max_group=0.25)


def capped(spark, portfolios, cap=po.cap_held_names):
    """Weights after the caps, for {portfolio: [(sector, weight), ...]}."""
    rows = [(p, i, s, float(w)) for p, names in portfolios.items() for i, (s, w) in enumerate(names)]
    df = spark.createDataFrame(rows, "portfolio_id string, security_id long, sector_id string, weight double")
    got = {p: [None] * len(names) for p, names in portfolios.items()}
    for r in cap(df, ["portfolio_id"], **CAPS).collect():
        got[r.portfolio_id][r.security_id] = r.weight
    return got


def test_caps_hold_and_money_is_placed_where_it_can_be(spark):
    books = {}
    for seed in range(8):
        rng = np.random.default_rng(100 + seed)
        n = 20 + 5 * seed
        books[f"b{seed}"] = list(zip((f"s{i % 6}" for i in range(n)), rng.pareto(1.5, n) + 0.05))
    folded, rounds = capped(spark, books), capped(spark, books, po.apply_weight_caps)
    for book, w in folded.items():
        assert w == pytest.approx(rounds[book], abs=1e-8)
        sectors = [s for s, _ in books[book]]
        base = [x for _, x in books[book]]
        held = {s: sum(x for x, t in zip(w, sectors) if t == s) for s in set(sectors)}
        assert min(w) >= 0 and max(w) <= 0.08 + 1e-8 and max(held.values()) <= 0.25 + 1e-8
        assert sum(w) == pytest.approx(1.0, abs=1e-8)
        for i in range(len(w)):  # inside a sector a larger base weight never ends smaller
            for j in range(len(w)):
                if sectors[i] == sectors[j] and base[i] > base[j]:
                    assert w[i] >= w[j] - 1e-9


def test_caps_by_hand(spark):
    got = capped(spark, {
        # Three sectors of five equal names: 3 x 0.25 is all that fits, so a quarter stays cash.
        "cash": [(s, 1.0) for s in "abc" for _ in range(5)],
        # Twenty equal names over five sectors meet no cap.
        "free": [(s, 1.0) for s in "abcde" for _ in range(4)],
        # One name of a half is cut to 0.08; the rest, in 19 sectors of their own, share 0.92 equally.
        "giant": [("g", 19.0)] + [(f"t{i}", 1.0) for i in range(19)],
    })
    assert got["cash"] == pytest.approx([0.05] * 15) and sum(got["cash"]) == pytest.approx(0.75)
    assert got["free"] == pytest.approx([0.05] * 20)
    assert got["giant"] == pytest.approx([0.08] + [0.92 / 19] * 19)


def weights(spark, rows):
    return spark.createDataFrame([("p", k, v) for k, v in rows], "portfolio_id string, security_id string, weight double")


def test_within_band_holds(spark):
    plan = po.plan_rebalance(weights(spark, [("A", 0.5), ("B", 0.5)]), weights(spark, [("A", 0.502), ("B", 0.498)]), ["portfolio_id"], 0.005, 1.0).collect()
    assert {r.side for r in plan} == {"HOLD"} and {r.reason for r in plan} == {"WITHIN_TRADE_BAND"}


def test_turnover_cap_and_initial_funding(spark):
    target = weights(spark, [("A", 0.2), ("B", 0.2), ("C", 0.3), ("D", 0.3)])
    plan = po.plan_rebalance(weights(spark, [("A", 0.5), ("B", 0.5)]), target, ["portfolio_id"], 0.005, 0.4)
    s = po.plan_summary(plan, ["portfolio_id"]).first()
    assert s.turnover == pytest.approx(0.4) and s.turnover_capped and s.invested == pytest.approx(1.0)
    fresh = po.plan_summary(po.plan_rebalance(weights(spark, []), target, ["portfolio_id"], 0.005, 0.4), ["portfolio_id"]).first()
    assert fresh.turnover == pytest.approx(1.0) and not fresh.turnover_capped


def signals(spark, rows):
    return spark.createDataFrame(rows, "d int, security_id long, decision string, composite_score double, volatility_63d double, sector_id string")


def test_selection_keeps_holdings_and_fills_to_minimum(spark):
    rows = [(1, 1, "NEUTRAL", 10.0, 0.2, "a"), (1, 2, "LONG", 90.0, 0.2, "a"), (1, 3, "WATCH", 80.0, None, "b"),
            (1, 4, "AVOID", 99.0, 0.2, "b"), (1, 5, "NEUTRAL", 70.0, 0.2, "b"), (1, 6, "WATCH", 60.0, 0.2, "c")]
    held = spark.createDataFrame([(1, 1), (1, 4)], "d int, security_id long")
    out = po.select_holdings(signals(spark, rows), held, ["d"], Sizing(min_holdings=4, max_holdings=5))
    assert sorted(r.security_id for r in out.collect()) == [1, 2, 3, 6]
    w = po.inverse_volatility(out, ["d"]).agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(1.0)


def test_risk_report_against_dense_matrices(spark):
    rng = np.random.default_rng(2)
    n, vols = 300, np.array([0.1, 0.2, 0.3, 0.6]) / np.sqrt(252)
    chol = np.linalg.cholesky(0.7 * np.eye(4) + 0.3)
    x = rng.normal(size=(n, 4)) @ chol.T * vols
    x[:200, 3] = np.nan  # a recent listing: below the coverage limit
    days = pd.bdate_range("2020-01-01", periods=n).date
    rows = [("p", j, days[i], None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(n) for j in range(4)]
    returns = spark.createDataFrame(rows, "portfolio_id string, security_id long, date date, ret double")
    w = np.array([0.4, 0.3, 0.2, 0.1])
    held = spark.createDataFrame([("p", j, float(w[j])) for j in range(4)], "portfolio_id string, security_id long, weight double")
    bench = spark.createDataFrame([("p", d, float(b)) for d, b in zip(days, x[:, 0])], "portfolio_id string, date date, benchmark_return double")
    report, contributions = rk.risk_report(held, returns, bench, ["portfolio_id"])

    good = np.nan_to_num(x[:, :3])
    c = good - good.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / 3
    d2 = ((s - mu * np.eye(3)) ** 2).sum() / 3
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (n * n * 3)
    k = min(b2, d2) / d2
    cov = np.zeros((4, 4))
    cov[:3, :3] = (k * mu * np.eye(3) + (1 - k) * s) * 252
    cov[3, 3] = np.median(np.diag(cov)[:3])
    var = w @ cov @ w
    got = report.first()
    assert got.volatility_annual == pytest.approx(np.sqrt(var), rel=1e-9)
    assert got.var_95_daily == pytest.approx(1.6448536269514722 * np.sqrt(var / 252), rel=1e-9)
    hist = np.nan_to_num(x) @ w
    assert got.historical_var_95_daily == pytest.approx(-np.quantile(hist, 0.05), rel=1e-9)
    assert got.beta == pytest.approx(np.cov(hist, x[:, 0])[0, 1] / np.var(x[:, 0], ddof=1), rel=1e-9)
    rc = {r.security_id: r.risk_contribution for r in contributions.collect()}
    np.testing.assert_allclose([rc[j] for j in range(4)], w * (cov @ w) / var, rtol=1e-8)


def test_newey_west_and_bh(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 60)
    df = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "factor string, i int, v double")
    e = x - x.mean()
    for lags in (0, 3):
        var = e @ e / 60 + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / 60 for k in range(1, lags + 1))
        assert rs.newey_west(df, ["factor"], "i", "v", lags, "t").first().t == pytest.approx(x.mean() / np.sqrt(var / 60))
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "k int, p double")
    q = {r.k: r.q for r in rs.benjamini_hochberg(p, "p", "q").collect()}
    assert [q[k] for k in (1, 2, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and q[5] is None


def test_verdict_never_flips_a_sign(spark):
    row = "factor string, mean_ic_1m double, nw_t_1m double, q_value_bh double"
    research = spark.createDataFrame([("good", 0.05, 4.0, 0.01), ("fades", 0.05, 4.0, 0.01), ("inverse", -0.05, -4.0, 0.01), ("noise", 0.01, 0.5, 0.6)], row)
    holdout = spark.createDataFrame([("good", 0.04, 1.5, 0.1), ("fades", -0.01, -0.2, 0.9), ("inverse", -0.05, -2.0, 0.1), ("noise", 0.0, 0.0, 0.9)], row)
    names = spark.createDataFrame([(f, "x", True, False) for f in ("good", "fades", "inverse", "noise")], "factor string, family string, higher_is_better boolean, in_strategy boolean")
    got = [(r.factor, r.verdict) for r in rs.verdicts(research, holdout, names).collect()]
    assert got == [("good", "ACCEPT"), ("fades", "FAILS_HOLDOUT"), ("inverse", "INVERTED"), ("noise", "NOT_SIGNIFICANT")]


def test_walk_forward_uses_the_past_only(spark):
    rng = np.random.default_rng(0)
    a = np.where(np.arange(400) < 200, 0.01, -0.01) + rng.normal(0, 0.001, 400)
    b = rng.normal(0, 0.001, 400)
    rows = [(c, i, float(v), 0.0) for c, s in (("A", a), ("B", b)) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "config_id string, pos long, ret double, benchmark_return double")
    stitched, folds = pf.walk_forward_selection(df, df.select("pos").distinct(), 100, 50, pf.OBJECTIVES["sharpe"]())
    chosen = {r.fold: r.config_id for r in folds.collect()}
    assert chosen[0] == "A" and chosen[max(chosen)] == "B"
    assert stitched.agg(F.min("pos"), F.count(F.lit(1))).first()[:] == (100, 300)


def test_performance_summary(spark):
    levels = np.array([100, 120, 60, 90, 130.0])
    rows = [("p", i, float(levels[i] / levels[i - 1] - 1)) for i in range(1, 5)]
    got = pf.performance_summary(spark.createDataFrame(rows, "p string, i int, ret double"), ["p"], "i").first()
    assert got.max_drawdown == pytest.approx(-0.5) and got.cumulative_return == pytest.approx(0.3)
    assert got.hit_rate == 0.75


def labelled(spark, revisions):
    rows = []
    for i, (c, rev) in enumerate(zip((0.97, 0.90), revisions)):
        rows.append((1, i, c, 0.9, 0.9, 0.9, 0.9, rev, 0.9, 0))
    names = ["as_of_date int", "security_id int", "composite_percentile double"] + [f"{f}_percentile double" for f in FAMILIES]
    df = spark.createDataFrame(rows, ", ".join([*names, "liquidity_percentile double", "risk_flag int"]))
    return [r.decision for r in cs.label_signals(df, Thresholds()).orderBy("security_id").collect()]


def test_gate_is_open_when_nobody_has_the_factor(spark):
    assert labelled(spark, (None, None)) == ["STRONG_LONG", "LONG"]
    assert labelled(spark, (0.9, 0.1)) == ["STRONG_LONG", "REDUCE"]


def test_overrides_reject_unknown_fields(spark):
    changed = apply_overrides(Strategy(), {"portfolio.weighting": "equal_weight"}, "v2")
    assert changed.portfolio.weighting == "equal_weight" and changed.strategy_version == "v2"
    with pytest.raises(KeyError):
        apply_overrides(Strategy(), {"portfolio.nothing": 1})
    grid = configuration_grid(spark, {"a": [1.0, 2.0, 3.0], "b": [0.5, 0.25], "c": [1, 7]})
    assert grid.columns == ["config_id", "a", "b", "c"] and grid.count() == 12
    first = grid.orderBy("config_id").collect()
    assert [r.config_id for r in first] == list(range(12)) and first[-1].asDict() == {"config_id": 11, "a": 3.0, "b": 0.25, "c": 7}


def test_refits_come_a_number_of_calendar_months_later():
    from datetime import date

    from quantloom.operators.ml import add_months

    assert add_months(date(2024, 5, 31), 3) == date(2024, 8, 31)
    assert add_months(date(2023, 11, 30), 3) == date(2024, 2, 29)
    assert add_months(date(2024, 1, 17), 14) == date(2025, 3, 17)
