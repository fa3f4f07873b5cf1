"""Distributed ranks, quantiles, winsorised percentiles against pandas."""

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import ranking as rk
from quantloom.operators import crosssection as cs


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 600
    frame = pd.DataFrame(
        {
            "day": rng.integers(0, 3, n),
            "sid": np.arange(n),
            "sector": rng.choice(["a", "b", "c", "tiny", None], n, p=[0.4, 0.3, 0.25, 0.01, 0.04]),
            "x": np.where(rng.random(n) < 0.33, 0.0, rng.normal(0, 3, n)),  # a third share one value
        }
    )
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    return frame


def to_spark(spark, frame):
    rows = [
        (int(r.day), int(r.sid), r.sector, None if pd.isna(r.x) else float(r.x)) for r in frame.itertuples()
    ]
    return spark.createDataFrame(rows, "day int, sid long, sector string, x double")


def test_average_percentile_matches_pandas(spark, sample):
    df = rk.with_percentiles(to_spark(spark, sample), ["day"], ["day", "sid"], {"p": "x"})
    got = df.toPandas().set_index("sid")["p"].sort_index()
    g = sample.groupby("day")["x"]
    want = (g.rank(method="average") - 0.5) / g.transform("count")
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=0, atol=1e-12)


def test_first_rank_breaks_ties_by_id(spark, sample):
    df = rk.first_rank(to_spark(spark, sample), ["day"], "x", "sid", "r", tie_span=16)
    got = df.toPandas().set_index("sid")["r"].sort_index()
    want = sample.dropna(subset=["x"]).groupby("day")["x"].rank(method="first")
    assert (got.to_numpy() == want.loc[got.index].to_numpy()).all()


@pytest.mark.parametrize("n", [6, 50, 53, 99, 101])
def test_equal_count_bucket_is_qcut(spark, n):
    ranks = spark.range(1, n + 1).withColumnRenamed("id", "r")
    from pyspark.sql import functions as F

    got = [r[0] for r in ranks.orderBy("r").select(rk.equal_count_bucket(F.col("r"), F.lit(n))).collect()]
    assert got == list(pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False))


def test_quantiles_are_exact(spark, sample):
    q = rk.group_quantiles(to_spark(spark, sample), ["day"], "x", {"lo": 0.01, "mid": 0.5}).toPandas()
    want = sample.groupby("day")["x"].quantile([0.01, 0.5]).unstack()
    np.testing.assert_allclose(q.set_index("day").sort_index()[["lo", "mid"]], want, atol=1e-12)


def reference_percentile(frame, up):
    out = []
    for _, g in frame.groupby("day"):
        v = g["x"]
        clipped = v.clip(v.quantile(0.01), v.quantile(0.99)) * (1 if up else -1)
        by = clipped.groupby(g["sector"])
        inside = (by.rank() - 0.5) / by.transform("count")
        whole = (clipped.rank() - 0.5) / clipped.count()
        out.append(inside.where(by.transform("count") >= 5, whole).where(v.notna()))
    return pd.concat(out).sort_index()


@pytest.mark.parametrize("up", [True, False])
def test_winsorised_sector_percentile(spark, sample, up):
    from pyspark.sql import functions as F

    df = to_spark(spark, sample).withColumn("up", F.lit(up))
    got = cs.winsorized_percentiles(df, ["day"], "x", "sector", "up").toPandas().set_index("sid")["pct"].sort_index()
    np.testing.assert_allclose(got.to_numpy(dtype=float), reference_percentile(sample, up).to_numpy(), atol=1e-12)


def test_small_sector_falls_back_to_universe(spark):
    rows = [(1, i, "A", float(i)) for i in range(1, 7)] + [(1, 9, "B", 10.0)]
    df = spark.createDataFrame(rows, "day int, sid long, sector string, x double")
    got = {r.sid: r.pct for r in cs.winsorized_percentiles(df, ["day"], "x", "sector").collect()}
    assert max(got, key=got.get) == 9 or got[9] == max(got.values())


def moved_rows(df):
    """How many shuffles of the plan carry ``sid``, that is, the rows and not counts of them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert "sid" in plan
    return sum("Exchange hashpartitioning" in a and "sid#" in " ".join(lines[i + 1 : i + 3]) for i, a in enumerate(lines))


def test_percentiles_move_the_rows_once(spark, sample):
    """Ranks of distinct values were joined back to the rows, with a shuffle of both for each join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = to_spark(spark, sample).where("x is not null")
        assert moved_rows(cs.winsorized_percentiles(long, ["day"], "x", "sector")) == 1
        assert moved_rows(rk.first_rank(long, ["day"], "x", "sid", "r")) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_correlation_matches_pandas(spark, sample):
    from quantloom.operators import research as rs

    frame = sample.assign(y=(sample["sid"] * 7919 % 101) / 7.0)
    rows = [(int(r.day), int(r.sid), None if pd.isna(r.x) else float(r.x), float(r.y)) for r in frame.itertuples()]
    df = spark.createDataFrame(rows, "day int, sid long, x double, y double")
    got = {r.day: r.ic for r in rs.spearman(df, ["day"], "x", "y", 10).collect()}
    known = frame.dropna(subset=["x"])
    for day, g in known.groupby("day"):
        assert abs(got[day] - g["x"].rank().corr(g["y"].rank())) < 1e-12
