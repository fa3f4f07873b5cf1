"""Risk limits as constraints on weights."""

import datetime
from dataclasses import replace

import numpy as np
import pytest

from quantloom.config import RiskLimits
from quantloom.operators import enforcement as en
from quantloom.operators import risk as rk

KEYS = ["book"]


def market(rng, days, vols, corr):
    """Daily returns with a common factor, by name number."""
    common, own = rng.normal(size=(days, 1)), rng.normal(size=(days, len(vols)))
    return (np.sqrt(corr) * common + np.sqrt(1 - corr) * own) * np.array(vols) / np.sqrt(252)


def tables(spark, books):
    """(weights, returns, benchmark) of {book: (weights, sectors, industries, returns, index)}."""
    start = datetime.date(2020, 1, 1)
    weights, returns, index = [], [], []
    for book, (w, sectors, industries, rets, bench) in books.items():
        weights += [(book, i, s, g, float(x)) for i, (x, s, g) in enumerate(zip(w, sectors, industries, strict=True))]
        for d, row in enumerate(rets):
            day = start + datetime.timedelta(d)
            returns += [(book, i, day, None if np.isnan(x) else float(x)) for i, x in enumerate(row)]
            index.append((book, day, float(bench[d])))
    return (
        spark.createDataFrame(weights, "book string, security_id long, sector_id string, industry_id string, weight double"),
        spark.createDataFrame(returns, "book string, security_id long, date date, ret double"),
        spark.createDataFrame(index, "book string, date date, benchmark_return double"),
    )


def solved(spark, books, limits, position, sector):
    weights, returns, index = tables(spark, books)
    out = en.enforced_limits(weights, returns, index, KEYS, limits, position, sector)
    return {r.book: ({n.security_id: n.weight for n in r.names}, r.actions) for r in out.collect()}, out, returns, index


def test_a_wild_name_is_trimmed_and_the_book_scaled(spark):
    rng = np.random.default_rng(11)
    wild = market(rng, 600, (0.15,) * 5 + (0.9,), 0.2)
    groups = (list("abcdef"), ["i1", "i1", "i2", "i3", "i4", None])
    calm = market(rng, 600, (0.1,) * 10, 0.1)
    names = [f"g{i}" for i in range(10)]
    books = {
        "wild": ([1 / 6] * 6, *groups, wild, wild.mean(1)),
        "calm": ([0.1] * 10, names, names, calm, calm.mean(1)),
        "alone": ([0.5], ["a"], ["b"], wild[:, :1], wild[:, 0]),
    }
    limits = RiskLimits(max_industry_weight=0.25, max_single_name_risk_contribution=0.30, max_portfolio_volatility=0.08, max_beta=9.0, min_gross_exposure=0.7)
    got, out, returns, index = solved(spark, books, limits, 0.5, 0.5)
    weights, actions = got["wild"]
    assert weights[0] + weights[1] <= 0.25 + 1e-6 and sum(weights.values()) > 0.7
    assert actions == [en.CAPS_APPLIED, en.TRIMMED, f"EXPOSURE_SCALED_TO_{sum(weights.values()):.0%}"]
    # The risk report of the result, by its own code, agrees: shares of variance hold.
    final = en.enforced_weights(out.where("book = 'wild'"), KEYS)
    report, shares = rk.risk_report(final, returns.where("book = 'wild'"), index.where("book = 'wild'"), KEYS)
    assert max(r.risk_contribution for r in shares.collect()) <= 0.30 + 1e-3
    assert report.first().volatility_annual == pytest.approx(0.08)
    floor = solved(spark, {"wild": books["wild"]}, replace(limits, min_gross_exposure=0.75), 0.5, 0.5)[0]["wild"]
    assert sum(floor[0].values()) == pytest.approx(0.75) and floor[1][-1] == "EXPOSURE_SCALED_TO_75%"
    assert got["alone"][0] == pytest.approx({0: 0.125})  # a half of the budget by the name's cap, then of that by its group's
    calm_limits = RiskLimits(max_industry_weight=0.3, max_single_name_risk_contribution=0.2)
    weights, actions = solved(spark, {"calm": books["calm"]}, calm_limits, 0.2, 0.3)[0]["calm"]
    assert actions == [] and weights == pytest.approx({i: 0.1 for i in range(10)})


def test_beta_and_value_at_risk_scale_towards_cash(spark):
    rng = np.random.default_rng(5)
    rets = market(rng, 400, (0.2,) * 5, 0.6)
    names = list("abcde")
    books = {"b": ([0.2] * 5, names, names, rets, rets.mean(1) / 2)}
    for limits, scale in ((RiskLimits(max_industry_weight=1.0, max_beta=1.6, max_single_name_risk_contribution=0.9, min_gross_exposure=0.1), 0.8), (RiskLimits(max_industry_weight=1.0, max_beta=1.0, max_single_name_risk_contribution=0.9), 0.8)):
        weights, actions = solved(spark, books, limits, 1.0, 1.0)[0]["b"]
        limits_reached = sum(weights.values())
        assert limits_reached == pytest.approx(scale) and actions[-1] == "EXPOSURE_SCALED_TO_80%"


def test_books_without_history(spark):
    nan = np.full((30, 3), np.nan)
    rets = market(np.random.default_rng(2), 30, (0.2,) * 3, 0.1)
    short = rets.copy()
    short[:25, 2] = np.nan
    names = list("abc")
    books = {"none": ([0.4, 0.3, 0.3], names, names, nan[:0], []), "unknown": ([0.4, 0.3, 0.3], names, names, nan, [0.0] * 30), "short": ([0.4, 0.3, 0.3], names, names, short, rets.mean(1))}
    limits = RiskLimits(max_industry_weight=1.0, max_single_name_risk_contribution=0.9, max_portfolio_volatility=9.0, max_var_95_daily=9.0, max_beta=9.0)
    got, out, *_ = solved(spark, books, limits, 0.35, 1.0)
    for book in books:
        weights, actions = got[book]
        assert weights == pytest.approx({0: 0.35, 1: 0.325, 2: 0.325}) and actions == [en.CAPS_APPLIED]
    weights, returns, index = tables(spark, {"short": books["short"]})
    nothing = en.enforced_limits(weights.where("weight < 0"), returns, index, KEYS, limits, 0.5, 0.5)
    assert nothing.count() == 0


def test_batches_do_not_mix_portfolios(spark):
    """A book's result is the same alone and beside others of other sizes."""
    rng = np.random.default_rng(9)
    books = {}
    for k in range(70):
        n = int(rng.integers(1, 12))
        w = rng.dirichlet(np.ones(n))
        rets = market(rng, int(rng.integers(5, 60)), rng.uniform(0.1, 0.6, n), 0.3)
        books[f"b{k}"] = (w, [f"s{i % 4}" for i in range(n)], [f"i{i % 5}" for i in range(n)], rets, rets.mean(1))
    limits = RiskLimits(max_industry_weight=0.4, max_single_name_risk_contribution=0.25, max_portfolio_volatility=0.15)
    together = solved(spark, books, limits, 0.3, 0.5)[0]
    for k in ("b0", "b33", "b69"):
        alone = solved(spark, {k: books[k]}, limits, 0.3, 0.5)[0]
        assert alone[k][0] == pytest.approx(together[k][0], abs=1e-9) and alone[k][1] == together[k][1]
