"""Tables between steps: what later plans see of them, and sums of candles."""

from pyspark.sql import functions as F

from quantloom.operators import series as se
from quantloom.plans import q_market
from quantloom.plans.catalog import QUERIES
from quantloom.session import cut_lineage


def test_a_staged_table_brings_no_constraints_of_its_plan(spark):
    """A checkpoint kept them, and every later join multiplied the expressions of the scores."""
    df = spark.range(20).selectExpr("id", "IF(id % 3 = 0, NULL, id / 2) AS x")
    scored = df.withColumn("score", F.when(F.col("x").isNotNull(), F.col("x") / 3)).where("score IS NOT NULL")
    held = cut_lineage(scored)
    assert held.inputFiles() and held._jdf.queryExecution().optimizedPlan().constraints().isEmpty()
    assert held.dtypes == scored.dtypes and sorted(held.collect()) == sorted(scored.collect())
    assert cut_lineage(df.limit(0)).dtypes == df.dtypes


def test_candle_sums_round_an_exact_half_up(spark, monkeypatch):
    """In floats these prices add up to 11762.499999999998."""
    cents = [270734, 118532, 149862, 207910, 191130, 238082]
    rows = [(1, f"2001-0{i + 1}-28", c / 100, 1.0) for i, c in enumerate(cents)]
    bars = spark.createDataFrame(rows, "security_id long, day string, close double, volume double")
    bars = bars.select("security_id", F.to_date("day").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume")
    monkeypatch.setattr(q_market.tb, "bars", lambda spark, sf: bars)
    monkeypatch.setattr(se, "display_bars", lambda bars: bars)
    assert QUERIES["columnar_candles"](spark, "").first()["close_sum"] == 11763.0


def test_a_snapshot_stages_no_bars(spark):
    """Bars are only read for the features; writing them again is work for nothing."""
    from pyspark.sql import functions as F

    from quantloom.config import MONTHLY
    from quantloom.operators import fundamentals as fu

    days = spark.range(6).select(F.col("id").alias("pos"), F.last_day(F.add_months(F.lit("2024-01-31").cast("date"), F.col("id").cast("int"))).alias("date"))
    prices = {c: F.lit(10.0) + F.col("pos") for c in ("open", "high", "low", "close", "price_close", "volume")}
    grid = days.withColumns({"security_id": F.lit(1).cast("long"), **prices})
    securities = spark.createDataFrame([(1, "T1", "a", "b")], "security_id long, ticker string, sector_id string, industry_id string")
    staged = []

    def materialize(df):
        staged.append(set(df.columns))
        return df

    got = fu.feature_snapshot(grid, securities, days.select(F.col("date").alias("as_of_date")), bars=MONTHLY, materialize=materialize)
    assert staged and not staged[0] & {"open", "high", "low", "close", "price_close", "volume", "ret", "pos"}
    assert [round(r.price) for r in got.orderBy("as_of_date").collect()] == [10, 11, 12, 13, 14, 15]


def test_a_snapshot_deals_statements_and_counts_by_security_once(spark):
    """Filing states, counts and membership meet a security's rows where they lie: no row of the
    snapshot crosses the network by security and date, and nothing is staged between."""
    from pyspark.sql import functions as F

    from quantloom.config import MONTHLY
    from quantloom.operators import fundamentals as fu

    month = lambda k: F.last_day(F.add_months(F.lit("2024-01-31").cast("date"), k.cast("int")))
    days = spark.range(6).select(F.col("id").alias("pos"), month(F.col("id")).alias("date"))
    ids = spark.range(1, 4).select(F.col("id").alias("security_id"))
    prices = {c: F.lit(10.0) + F.col("pos") + F.col("security_id") for c in ("open", "high", "low", "close", "price_close", "volume")}
    grid = days.crossJoin(ids).withColumns(prices)
    securities = ids.select("security_id", F.lit("T").alias("ticker"), F.lit("a").alias("sector_id"), F.lit("b").alias("industry_id"))
    estimates = spark.createDataFrame(
        [(1, "2024-02-10", 2.0, 3, 1), (1, "2024-04-30", 4.0, 1, 0), (2, "2024-03-05", 5.0, 0, 2)],
        "security_id long, day string, fy1_eps_estimate double, n_revisions_up long, n_revisions_down long",
    ).withColumn("available_at", F.to_date("day")).drop("day")
    live = spark.createDataFrame([(1, "2024-03-01", None), (3, None, "2024-02-29")], "security_id long, start string, end string")
    live = live.select("security_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    staged = []
    got = fu.feature_snapshot(
        grid, securities, days.select(F.col("date").alias("as_of_date")), estimates=estimates, membership=live, bars=MONTHLY,
        materialize=lambda df: staged.append(df) or df,
    )
    rows = {(r.security_id, r.as_of_date.month): r for r in got.collect()}
    assert len(rows) == 18 and not staged
    # Counts hold for the thirty days before a date only; the estimate itself is carried on.
    assert [rows[1, m].revisions_up_ratio for m in range(1, 7)] == [None, 0.75, None, 1.0, None, None]
    assert [rows[1, m].estimates_available_at is not None for m in range(1, 7)] == [False] + [True] * 5
    assert [rows[1, m].in_universe for m in range(1, 7)] == [False, False, True, True, True, True]
    assert [rows[3, m].in_universe for m in range(1, 7)] == [True] + [False] * 5
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [x for x in plan.splitlines() if "hashpartitioning(security_id" in x and "as_of_date" in x.split("hashpartitioning(")[1].split(")")[0]]
