"""What is written and read back: saved markets, reports, keyed documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.plans import testbed as tb
from quantloom.plans.registry import query, rounded
from quantloom.session import checkpoint_folder
from quantloom.sources import tables


def folder(spark, name):
    """A new folder under the one all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("market_round_trip", """
SELECT 'securities' AS name, count(*) AS n, sum(security_id)::DOUBLE AS total FROM t_securities UNION ALL SELECT 'prices', count(*), round(sum(volume), 2) FROM t_bars
UNION ALL SELECT 'fundamentals', count(*), round(sum(revenue), 2) FROM t_fundamentals UNION ALL SELECT 'estimates', count(*), round(sum(fy1_eps_estimate), 2) FROM t_estimates
UNION ALL SELECT 'shares', count(*), round(sum(shares_outstanding), 2) FROM t_shares""")
def _(spark, sf):
    """The market saved (prices by year) and loaded again; tables it does not have are absent."""
    path = folder(spark, "market")
    wanted = {"securities": ("security_id", tb.securities), "prices": ("volume", tb.bars), "fundamentals": ("revenue", tb.fundamentals),
              "estimates": ("fy1_eps_estimate", tb.estimates), "shares": ("shares_outstanding", tb.shares)}
    metadata = spark.createDataFrame([("suppliers_monthly", "all suppliers")], "data_version string, universe string")
    tables.save_market({name: build(spark, sf) for name, (_, build) in wanted.items()}, metadata, path)
    found, _ = tables.load_market(spark, path)
    out = None
    for name, df in found.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(wanted[name][0]).cast("double")).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 2)


@query("saved_prices", "SELECT security_id, date, close, volume FROM t_bars WHERE year(date) = 1997")
def _(spark, sf):
    """One year of a saved market: only that year's files are read."""
    path = folder(spark, "market")
    small = {"securities": tb.securities(spark, sf), "prices": tb.bars(spark, sf), "fundamentals": tb.fundamentals(spark, sf)}
    tables.save_market(small, spark.createDataFrame([("all",)], "universe string"), path)
    year = tables.load_market(spark, path)[0]["prices"].where("year = 1997")
    return rounded(year.select("security_id", "date", "close", "volume"), exact=("close",))


@query("report_round_trip", """
SELECT security_id, ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM t_bars JOIN t_securities USING (security_id) GROUP BY 1, 2""")
def _(spark, sf):
    """A report with an array column written as CSV and read back."""
    path = folder(spark, "report")
    report = tb.bars(spark, sf).join(tb.securities(spark, sf), "security_id").groupBy("security_id", "ticker").agg(F.sort_array(F.collect_list("date")).alias("dates"))
    tables.write_report({"bars": report}, path)
    back = spark.read.option("header", True).csv(f"{path}/bars", schema="security_id long, ticker string, dates string")
    dates = F.from_json("dates", "array<date>")
    return back.select("security_id", "ticker", F.size(dates).cast("bigint").alias("n"), F.array_min(dates).alias("first_date"), F.array_max(dates).alias("last_date"))


@query("keyed_documents", "SELECT security_id, count(*) AS n_bars, round(sum(volume), 2) AS volume, max(date) AS last_date FROM t_bars GROUP BY 1")
def _(spark, sf):
    """Every security's bars as one JSON document, found again through the key index."""
    path = folder(spark, "documents")
    rows = tb.bars(spark, sf).groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct("date", "volume"))).alias("bars"))
    tables.write_keyed_json(rows, "security_id", path)
    back = tables.read_keyed_json(spark, path, "security_id", rows.schema)
    bars = back.select("security_id", F.explode("bars").alias("bar")).select("security_id", "bar.*")
    return rounded(bars.groupBy("security_id").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume"), F.max("date").alias("last_date")), 2)
