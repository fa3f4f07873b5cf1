"""Queries that need a part of the factor research run that part alone."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import research as rs
from quantloom.plans import pipeline as pl
from quantloom.plans.catalog import QUERIES


def test_significance_equals_the_columns_of_the_summary(spark):
    rng = np.random.default_rng(5)
    rows = [
        (f"f{k}", dt.date(2000 + m // 12, m % 12 + 1, 1), h, None if rng.random() < 0.1 else float(rng.normal(0.02 * k, 0.05)))
        for k in range(6) for m in range(5 if k == 5 else 40) for h in rs.HORIZONS
    ]
    ic = spark.createDataFrame(rows, "factor string, as_of_date date, horizon int, ic double")
    day = "as_of_date date, factor string"
    parts = [spark.createDataFrame([], f"{day}, {c}") for c in ("q1 double, q2 double, q3 double, q4 double, q5 double", "turnover double", "coverage double")]
    columns = ("months", "nw_t_1m", "p_value", "q_value_bh")
    want = {r.factor: [r[c] for c in columns] for r in rs.summarize_factors(ic, *parts).collect()}
    got = {r.factor: [r[c] for c in columns] for r in rs.significance(ic).collect()}
    assert got.keys() == want.keys() == {f"f{k}" for k in range(5)}
    for factor, values in got.items():
        assert values == pytest.approx(want[factor], rel=1e-9)


@pytest.mark.parametrize("name", ["ic_by_year", "factor_significance"])
def test_only_returns_of_one_period_are_ranked(spark, monkeypatch, name):
    asked = []

    def panel_ic(spark, sf, horizons=rs.HORIZONS):
        asked.append(tuple(horizons))
        return spark.range(0).select(
            F.lit(None).cast("date").alias("as_of_date"), F.lit("").alias("factor"),
            F.lit(1).alias("horizon"), F.lit(0.0).alias("ic"))

    def unused(*_):
        raise AssertionError("not read by this query")

    monkeypatch.setattr(pl, "panel_ic", panel_ic)
    monkeypatch.setattr(pl, "panel_buckets", unused)
    monkeypatch.setattr(pl, "panel_coverage", unused)
    QUERIES[name](spark, "none")
    assert asked == [(1,)]


def test_a_study_of_factors_deals_rows_once_and_equals_its_parts(spark):
    """Ranks against all returns, buckets and coverage come from one deal of the rows, with values and
    returns missing and keys repeated."""
    from quantloom.operators import crosssection as cs

    rng = np.random.default_rng(3)
    features, days = {"a": True, "b": False, "c": True}, [dt.date(2000, m, 28) for m in range(1, 5)]
    universe, returns = [], []
    for day in days:
        for s in range(150):
            x = [None if rng.random() < 0.1 else float(v) for v in np.round(rng.normal(size=3), 1)]
            row = (day, s, f"s{s % 3}", x[0], x[1], x[2] if day != days[3] else None)
            universe += [row, row] if s == 7 else [row]
            for h in rs.HORIZONS:
                if rng.random() > 0.1:
                    one = (day, s, h, None if rng.random() < 0.1 else float(rng.normal()))
                    returns += [one, (day, s, h, float(rng.normal()))] if s in (7, 9) else [one]
    universe = spark.createDataFrame(universe, "as_of_date date, security_id long, sector_id string, a double, b double, c double").repartition(3)
    returns = spark.createDataFrame(returns, "as_of_date date, security_id long, horizon int, forward_return double").repartition(3)
    size = universe.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("universe"))
    study = rs.factor_study(universe, features, returns, size)
    rows = {(r.as_of_date, r.factor): r for r in study.collect()}

    up = F.when(F.col("factor") == "b", False).otherwise(True)
    long = universe.unpivot(["as_of_date", "security_id", "sector_id"], list(features), "factor", "value").withColumn("up", up)
    pct = cs.winsorized_percentiles(long, ["as_of_date", "factor"], higher_is_better="up", with_unknown=False).where("value is not null")
    panel = rs.guarded_percentiles(pct, size)
    joined = panel.join(returns, ["as_of_date", "security_id"])
    keys = ["as_of_date", "factor"]
    assert rows.keys() == {(r.as_of_date, r.factor) for r in panel.select(*keys).distinct().collect()} and len(rows) == 11
    for r in panel.select(*keys, "factor_size", "universe").distinct().collect():
        assert (rows[r.as_of_date, r.factor].factor_size, rows[r.as_of_date, r.factor].universe) == (r.factor_size, r.universe)
    for r in rs.spearman(joined, [*keys, "horizon"], "pct", "forward_return", rs.MIN_CROSS_SECTION).collect():
        assert rows[r.as_of_date, r.factor][f"ic_{r.horizon}"] == pytest.approx(r.ic, abs=1e-12)
    # Names with repeated keys may stand in either of two buckets, so they are left out here.
    single = returns.where("security_id not in (7, 9)")
    alone = {(r.as_of_date, r.factor): r for r in rs.factor_study(universe.where("security_id <> 7"), features, single, size).collect()}
    buckets = rs.bucketed(panel_of(universe.where("security_id <> 7"), size, features).join(single.where("horizon = 1"), keys[:1] + ["security_id"]), keys, "pct", "forward_return", rs.MIN_BUCKET_PAIRS)
    for r in rs.quintile_returns(buckets, keys, "forward_return").collect():
        assert [alone[r.as_of_date, r.factor][f"q{i}"] for i in range(1, 6)] == pytest.approx([r[f"q{i}"] for i in range(1, 6)], abs=1e-12)
    top = {}
    for r in buckets.where("bucket = 4").collect():
        top.setdefault((r.as_of_date, r.factor), []).append(r.security_id)
    assert {k: sorted(r.top) for k, r in alone.items()} == {k: sorted(v) for k, v in top.items()}
    plan = study._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"hashpartitioning\([^)]*\), REPARTITION_BY_NUM", plan)) == 1 and "_bucket" not in plan


def panel_of(universe, size, features):
    from quantloom.operators import crosssection as cs

    return rs.guarded_percentiles(cs.feature_percentiles(universe, features), size)
