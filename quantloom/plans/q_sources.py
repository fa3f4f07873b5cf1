"""Ingestion queries: nested facts, vendor text tables, membership histories, id resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import scalars as sc
from quantloom.operators import intervals as iv
from quantloom.plans import pipeline as pl, testbed as tb
from quantloom.plans.oracle import block
from quantloom.plans.q_market import rs as rnd
from quantloom.plans.registry import query, rounded, staged
from quantloom.sources import contracts, sic, text, xbrl

# ---------------------------------------------------------------- nested company facts
_YEAR = "CAST(date_trunc('year', event_time) AS DATE)"
block("t_ytd", """
SELECT *, sum(revenue) OVER y AS revenue_ytd, sum(net_income) OVER y AS income_ytd, sum(free_cash_flow) OVER y AS cash_ytd
FROM t_fundamentals WINDOW y AS (PARTITION BY security_id, year(event_time) ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
block("t_facts", f"""
SELECT security_id, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, CAST(date_trunc('quarter', event_time) AS DATE) AS s, event_time AS e, revenue AS val, available_at AS filed, '10-Q' AS form FROM t_fundamentals WHERE quarter(event_time) < 4
UNION ALL SELECT security_id, 'us-gaap', 'Revenues', 'USD', {_YEAR}, event_time, revenue_ytd, available_at, CASE WHEN quarter(event_time) = 4 THEN '10-K' ELSE '10-Q' END FROM t_ytd WHERE quarter(event_time) > 1
UNION ALL SELECT security_id, 'us-gaap', 'Revenues', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue * 0.8::DOUBLE, available_at + 200, '10-Q/A' FROM t_fundamentals WHERE quarter(event_time) < 4
UNION ALL SELECT security_id, 'us-gaap', 'CostOfRevenue', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue - gross_profit, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 2 = 0
UNION ALL SELECT security_id, 'us-gaap', 'CostOfGoodsSold', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue - gross_profit + 1, available_at, '10-Q' FROM t_fundamentals
UNION ALL SELECT security_id, 'us-gaap', 'NetIncomeLoss', 'USD', {_YEAR}, event_time, income_ytd, available_at, '10-Q' FROM t_ytd
UNION ALL SELECT security_id, 'us-gaap', 'NetCashProvidedByUsedInOperatingActivities', 'USD', {_YEAR}, event_time, cash_ytd, available_at + 2, '10-Q' FROM t_ytd
UNION ALL SELECT security_id, 'us-gaap', 'PaymentsToAcquireProductiveAssets', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, ebitda, available_at, '8-K' FROM t_fundamentals WHERE security_id % 3 = 0
UNION ALL SELECT security_id, 'us-gaap', 'PaymentsToAcquirePropertyPlantAndEquipment', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue * 4, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 6 = 0
UNION ALL SELECT security_id, 'us-gaap', 'OperatingIncomeLoss', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, ebitda - revenue, available_at, '10-Q' FROM t_fundamentals
UNION ALL SELECT security_id, 'us-gaap', 'Depreciation', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue * 2, available_at + 3, '10-Q' FROM t_fundamentals
UNION ALL SELECT security_id, 'us-gaap', 'DepreciationAndAmortization', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, revenue * 3, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 4 = 0
UNION ALL SELECT security_id, 'us-gaap', 'GrossProfit', 'USD', CAST(date_trunc('quarter', event_time) AS DATE), event_time, gross_profit + 2, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 5 = 0
UNION ALL SELECT security_id, 'us-gaap', 'LongTermDebt', 'USD', NULL, event_time, invested_capital * 2, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 2 = 0
UNION ALL SELECT security_id, 'us-gaap', 'LongTermDebtCurrent', 'USD', NULL, event_time - CAST(security_id % 9 AS INTEGER), invested_capital * 3, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 4 = 0
UNION ALL SELECT security_id, 'us-gaap', 'CommercialPaper', 'USD', NULL, event_time, invested_capital * 5, available_at, '10-Q' FROM t_fundamentals WHERE security_id % 7 = 0
UNION ALL SELECT security_id, 'us-gaap', 'StockholdersEquity', 'USD', NULL, event_time, invested_capital, available_at, '10-Q' FROM t_fundamentals
UNION ALL SELECT security_id, 'us-gaap', 'Cash', 'USD', NULL, event_time + CAST(security_id % 10 AS INTEGER), net_debt, available_at + 1, '10-Q' FROM t_fundamentals
""")
block("t_first_filed", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, concept, unit, s, e ORDER BY filed) AS k FROM t_facts
WHERE form IN ('10-Q', '10-K', '10-Q/A', '10-K/A', '10-KT', '10-QT')) WHERE k = 1
""")
block("t_flows", """
SELECT security_id, concept, unit, e, value, available_at FROM (
 SELECT *, row_number() OVER (PARTITION BY security_id, concept, unit, e ORDER BY direct DESC, o) AS k FROM (
  SELECT security_id, concept, unit, e, val AS value, filed AS available_at, 1 AS direct, -epoch(filed) AS o FROM t_first_filed WHERE e - s BETWEEN 75 AND 105
  UNION ALL
  SELECT security_id, concept, unit, e, val - pv, greatest(filed, pf), 0, epoch(s) FROM (
   SELECT *, lag(val) OVER c AS pv, lag(filed) OVER c AS pf, e - lag(e) OVER c AS gap FROM t_first_filed WHERE s IS NOT NULL AND e - s <= 390
   WINDOW c AS (PARTITION BY security_id, concept, unit, s ORDER BY e)) WHERE gap BETWEEN 75 AND 105)) WHERE k = 1
""")
block("t_lines_by_measure", """
SELECT f.security_id, m.measure, f.e, arg_min(f.value, m.p) AS value, arg_min(f.available_at, m.p) AS available_at
FROM (SELECT security_id, concept, e, value, available_at FROM t_flows UNION ALL SELECT security_id, concept, e, val, filed FROM t_first_filed WHERE s IS NULL) f
JOIN (VALUES ('revenue', 'Revenues', 0), ('cost', 'CostOfRevenue', 0), ('cost', 'CostOfGoodsSold', 2), ('income', 'NetIncomeLoss', 0),
      ('cash_flow', 'NetCashProvidedByUsedInOperatingActivities', 0), ('equity', 'StockholdersEquity', 0), ('cash', 'Cash', 2),
      ('gross', 'GrossProfit', 0), ('operating', 'OperatingIncomeLoss', 0), ('depreciation', 'DepreciationAndAmortization', 2), ('depreciation', 'Depreciation', 3),
      ('capex', 'PaymentsToAcquirePropertyPlantAndEquipment', 0), ('capex', 'PaymentsToAcquireProductiveAssets', 1),
      ('long_debt', 'LongTermDebt', 0), ('current_debt', 'LongTermDebtCurrent', 1), ('borrowings', 'CommercialPaper', 1)) m(measure, concept, p) ON m.concept = f.concept
GROUP BY 1, 2, 3
""")


def near(measure: str, column: str) -> str:
    return (f"(SELECT x.{column} FROM t_lines_by_measure x WHERE x.security_id = b.security_id AND x.measure = '{measure}' AND abs(x.e - b.e) <= 7 "
            "ORDER BY abs(x.e - b.e), x.e LIMIT 1)")


_ITEMS = ("revenue", "gross", "cost", "operating", "depreciation", "income", "cash_flow", "capex", "equity", "cash", "long_debt", "current_debt", "borrowings")
# Who ever reports capital expenditure, in whatever form, needs it; for all others none is none.
block("t_statements", f"""
SELECT security_id, e AS event_time, greatest({", ".join(f"{m}_at" for m in _ITEMS)}) AS available_at, revenue, coalesce(gross, revenue - cost) AS gross_profit,
  operating + depreciation AS ebitda, income AS net_income, cash_flow - CASE WHEN security_id % 3 = 0 THEN capex ELSE 0 END AS free_cash_flow,
  equity + coalesce(debt, 0) - coalesce(cash, 0) AS invested_capital, debt - coalesce(cash, 0) AS net_debt
FROM (SELECT *, CASE WHEN coalesce(long_debt, current_debt, borrowings) IS NOT NULL THEN coalesce(long_debt, 0) + coalesce(current_debt, 0) + coalesce(borrowings, 0) END AS debt FROM (
  SELECT b.security_id, b.e, {", ".join(f"{near(m, 'value')} AS {m}, {near(m, 'available_at')} AS {m}_at" for m in _ITEMS)}
  FROM (SELECT security_id, e FROM t_lines_by_measure WHERE measure = 'revenue') b))
""")


def fact_table(spark, sf) -> DataFrame:
    """Reported facts of every supplier: quarters, year-to-date chains, restatements, instants."""
    f = tb.fundamentals(spark, sf)
    from pyspark.sql import Window

    year = Window.partitionBy("security_id", F.year("event_time")).orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumns({f"{m}_ytd": F.sum(m).over(year) for m in ("revenue", "net_income", "free_cash_flow")})
    quarter, ytd, none = F.trunc("event_time", "quarter"), F.trunc("event_time", "year"), F.lit(None).cast("date")
    q, sid, filed = F.quarter("event_time"), F.col("security_id"), F.col("available_at")

    def rows(concept, start, value, form, where=None, end=F.col("event_time"), at=filed):
        part = f if where is None else f.where(where)
        return part.select("security_id", F.lit("us-gaap").alias("taxonomy"), F.lit(concept).alias("concept"), F.lit("USD").alias("unit"),
                           start.alias("start"), end.alias("end"), value.alias("val"), at.alias("filed"), form.alias("form"))

    # Whole multiples keep the four decimals of the amounts, so no check rounds a tie.
    ten_q = F.lit("10-Q")
    parts = [
        rows("Revenues", quarter, F.col("revenue"), ten_q, q < 4),
        rows("Revenues", ytd, F.col("revenue_ytd"), F.when(q == 4, "10-K").otherwise("10-Q"), q > 1),
        rows("Revenues", quarter, F.col("revenue") * 0.8, F.lit("10-Q/A"), q < 4, at=F.date_add(filed, 200)),
        rows("CostOfRevenue", quarter, F.col("revenue") - F.col("gross_profit"), ten_q, sid % 2 == 0),
        rows("CostOfGoodsSold", quarter, F.col("revenue") - F.col("gross_profit") + 1, ten_q),
        rows("NetIncomeLoss", ytd, F.col("net_income_ytd"), ten_q),
        rows("NetCashProvidedByUsedInOperatingActivities", ytd, F.col("free_cash_flow_ytd"), ten_q, at=F.date_add(filed, 2)),
        rows("PaymentsToAcquireProductiveAssets", quarter, F.col("ebitda"), F.lit("8-K"), sid % 3 == 0),
        rows("PaymentsToAcquirePropertyPlantAndEquipment", quarter, F.col("revenue") * 4, ten_q, sid % 6 == 0),
        rows("OperatingIncomeLoss", quarter, F.col("ebitda") - F.col("revenue"), ten_q),
        rows("Depreciation", quarter, F.col("revenue") * 2, ten_q, at=F.date_add(filed, 3)),
        rows("DepreciationAndAmortization", quarter, F.col("revenue") * 3, ten_q, sid % 4 == 0),
        rows("GrossProfit", quarter, F.col("gross_profit") + 2, ten_q, sid % 5 == 0),
        rows("LongTermDebt", none, F.col("invested_capital") * 2, ten_q, sid % 2 == 0),
        rows("LongTermDebtCurrent", none, F.col("invested_capital") * 3, ten_q, sid % 4 == 0, end=F.date_sub("event_time", (sid % 9).cast("int"))),
        rows("CommercialPaper", none, F.col("invested_capital") * 5, ten_q, sid % 7 == 0),
        rows("StockholdersEquity", none, F.col("invested_capital"), ten_q),
        rows("Cash", none, F.col("net_debt"), ten_q, end=F.date_add("event_time", (sid % 10).cast("int")), at=F.date_add(filed, 1)),
    ]
    shares = tb.shares(spark, sf).select(
        "security_id",
        F.when(sid % 2 == 0, "us-gaap").otherwise("dei").alias("taxonomy"),
        F.when(sid % 2 == 0, xbrl.SHARE_CONCEPT).otherwise(xbrl.COVER_SHARE_CONCEPT).alias("concept"),
        F.lit("shares").alias("unit"),
        F.when(sid % 2 == 0, F.trunc(F.date_sub("available_at", 20), "quarter")).alias("start"),
        F.date_sub("available_at", 20).alias("end"), F.col("shares_outstanding").alias("val"),
        F.col("available_at").alias("filed"), ten_q.alias("form"))
    return reduce(DataFrame.unionByName, [*parts, shares])


def documents(spark, sf) -> DataFrame:
    """The facts as one nested JSON document per company (a few hundred facts each)."""
    fact = F.struct(*[F.col(c).cast("string").alias(c) for c in ("start", "end", "val", "filed", "form")])
    lists = fact_table(spark, sf).groupBy("security_id", "taxonomy", "concept", "unit").agg(F.sort_array(F.collect_list(fact)).alias("f"))
    units = lists.groupBy("security_id", "taxonomy", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "f"))).alias("units"))
    concepts = units.groupBy("security_id", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
    facts = concepts.groupBy("security_id").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "c"))).alias("facts"))
    return facts.select("security_id", F.to_json(F.struct("facts")).alias("document"))


def facts(spark, sf) -> DataFrame:
    return staged(spark, sf, "facts", lambda: xbrl.fact_rows(documents(spark, sf)))


@query("company_fact_rows", 'SELECT security_id, concept, s AS start, e AS "end", round(val, 4) AS val, filed, form FROM t_facts')
def _(spark, sf):
    gaap = facts(spark, sf).where("taxonomy = 'us-gaap' and unit = 'USD'")
    return rounded(gaap.select("security_id", "concept", "start", "end", "val", "filed", "form"), 4)


@query("first_filed_facts", 'SELECT security_id, concept, s AS start, e AS "end", round(val, 4) AS val, filed FROM t_first_filed')
def _(spark, sf):
    kept = xbrl.first_filed(facts(spark, sf).where("taxonomy = 'us-gaap' and unit = 'USD'"))
    return rounded(kept.select("security_id", "concept", "start", "end", "val", "filed"), 4)


@query("quarterly_flows", 'SELECT security_id, concept, e AS "end", round(value, 4) AS value, available_at FROM t_flows')
def _(spark, sf):
    kept = xbrl.first_filed(facts(spark, sf).where("taxonomy = 'us-gaap' and unit = 'USD'"))
    return rounded(xbrl.quarterly_flows(kept).drop("unit"), 4)


@query("instant_values", 'SELECT security_id, concept, e AS "end", round(val, 4) AS value, filed AS available_at FROM t_first_filed WHERE s IS NULL')
def _(spark, sf):
    kept = xbrl.first_filed(facts(spark, sf).where("taxonomy = 'us-gaap' and unit = 'USD'"))
    return rounded(xbrl.instant_values(kept).drop("unit"), 4)


_LINES = ("revenue", "gross_profit", "ebitda", "net_income", "free_cash_flow", "invested_capital", "net_debt")


@query("company_statements", f"SELECT security_id, event_time, available_at, {rnd(*_LINES, digits=4)} FROM t_statements WHERE available_at IS NOT NULL")
def _(spark, sf):
    df = xbrl.statements(facts(spark, sf))
    return rounded(df.select("security_id", "event_time", "available_at", *_LINES), 4)


@query("company_share_counts", "SELECT security_id, available_at, shares_outstanding FROM t_shares")
def _(spark, sf):
    return xbrl.share_counts(facts(spark, sf))


# ---------------------------------------------------------------- scalar functions and lookups
@query("normalized_tickers", """
SELECT p_partkey, replace(upper(trim(p_name || '.' || p_brand || ' ')), '.', '-') AS ticker,
  trim(regexp_replace(lower(p_brand || ' & ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS snake_name FROM part""")
def _(spark, sf):
    part = tb.read(spark, sf, "part")
    return part.select(
        "p_partkey", sc.normalize_ticker(F.concat("p_name", F.lit("."), "p_brand", F.lit(" "))).alias("ticker"),
        sc.snake(F.concat("p_brand", F.lit(" & "), "p_type", F.lit("!"))).alias("snake_name"))


_STOP = ", ".join(f"'{w}'" for w in sc.NAME_STOPWORDS)


def name_sql(x: str) -> str:
    return (f"array_to_string(list_filter(string_split(trim(regexp_replace(replace(upper({x}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), ' '), "
            f"lambda w: w NOT IN ({_STOP})), ' ')")


_RAW_NAME = "'The ' || p_name || ' & ' || p_type || ' Co., Inc.'"
block("t_part_names", f"SELECT p_partkey, {_RAW_NAME} AS raw, {name_sql(_RAW_NAME)} AS name_key FROM part")


@query("company_names", """
SELECT p_partkey, name_key, name_key <> '' AND (starts_with(name_key, other) OR starts_with(other, name_key)) AND other <> '' AS matches
FROM (SELECT *, """ + name_sql("split_part(raw, '&', 1)") + """ AS other FROM t_part_names)""")
def _(spark, sf):
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_type", F.lit(" Co., Inc."))
    part = tb.read(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return part.select("p_partkey", sc.normalize_company_name("raw").alias("name_key"),
                       sc.names_match("raw", F.split("raw", "&")[0]).alias("matches"))


@query("company_number_lookup", """
SELECT DISTINCT name_key, p_partkey AS cik FROM t_part_names WHERE name_key <> ''""")
def _(spark, sf):
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_type", F.lit(" Co., Inc."))
    lines = tb.read(spark, sf, "part").select(F.concat(raw, F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":")).alias("value"))
    return text.parse_name_lookup(lines)


@query("unique_company_names", """
SELECT name_key, count(*) AS companies, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS only_cik FROM t_part_names WHERE name_key <> '' GROUP BY 1""")
def _(spark, sf):
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_type", F.lit(" Co., Inc."))
    pairs = tb.read(spark, sf, "part").select(sc.normalize_company_name(raw).alias("name_key"), F.col("p_partkey").alias("cik"))
    return text.unique_names(pairs.where("name_key <> ''"))


@query("composition_rows", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, t AS security_id FROM (SELECT l_shipdate, unnest(['BRK-' || l_suppkey, 'P' || l_partkey]) AS t FROM lineitem)""")
def _(spark, sf):
    table = tb.read(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("brk."), F.col("l_suppkey").cast("string"), F.lit(", P"), F.col("l_partkey").cast("string"), F.lit(", ")).alias("tickers"))
    return text.parse_composition(table)


@query("change_log_rows", """
SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS added, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'K-' || (o_custkey + 1) END AS removed, 'Customer ' || o_custkey AS removed_name
FROM orders WHERE o_orderkey % 4 <> 3""")
def _(spark, sf):
    k = F.col("o_custkey").cast("string")
    shown = (F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when(F.col("o_orderkey") % 4 == 1, F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("[12]")))
             .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("undated"))
    table = tb.read(spark, sf, "orders").select(
        shown.alias("Effective Date"), F.concat(F.lit(" c"), k, F.lit("[3] ")).alias("Added Ticker"),
        F.when(F.col("o_orderstatus") == "P", F.lit("[9]")).otherwise(F.concat(F.lit("k."), (F.col("o_custkey") + 1).cast("string"))).alias("Removed Ticker"),
        F.concat(F.lit(" Customer "), k).alias("Removed Security"))
    return text.parse_changes(table)


@query("constituent_rows", """
SELECT 'BRK-' || s_suppkey AS security_id, 'brk.' || s_suppkey AS ticker, replace(lower(sector_id), ' ', '_') AS sector_id, lower(industry_id) AS industry_id,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey END AS cik FROM supplier JOIN t_securities ON security_id = s_suppkey""")
def _(spark, sf):
    sid = F.col("security_id").cast("string")
    table = tb.securities(spark, sf).select(
        F.concat(F.lit(" brk."), sid).alias("Symbol"), F.col("sector_id").alias("GICS Sector"), F.concat(F.col("industry_id"), F.lit(" ")).alias("GICS Sub-Industry"),
        F.when(F.col("security_id") % 5 == 0, "n/a").otherwise(sid).alias("CIK"))
    return text.parse_constituents(table)


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
block("t_region_raw", """
SELECT r_name AS security_id, date, CASE WHEN r_name <> 'ASIA' THEN max(price_close) END AS c, max(close) AS a, max(open) AS o, max(high) AS h, min(low) AS l, sum(volume) AS v
FROM t_bars JOIN supplier ON s_suppkey = security_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2
""")


def region_wide(spark, sf) -> DataFrame:
    """One wide vendor frame: a column per region and field; one region has no closes."""
    named = tb.bars(spark, sf).join(tb.securities(spark, sf).select("security_id", "sector_id"), "security_id")
    fields = {"Close": F.max, "Adj Close": F.max, "Open": F.max, "High": F.max, "Low": F.min, "Volume": F.sum}
    source = {"Close": "price_close", "Adj Close": "close", "Open": "open", "High": "high", "Low": "low", "Volume": "volume"}
    cells = []
    for region in _REGIONS:
        for field, f in fields.items():
            if region == "ASIA" and field == "Close":
                continue
            cells.append(f(F.when(F.col("sector_id") == region, F.col(source[field]))).alias(f"{region}|{field}"))
    return named.groupBy("date").agg(*cells)


@query("vendor_bars", "SELECT security_id, date, o * (a / c) AS open, h * (a / c) AS high, l * (a / c) AS low, a AS close, c AS price_close, v AS volume FROM t_region_raw WHERE security_id <> 'ASIA'")
def _(spark, sf):
    return text.assemble_prices(text.split_by_symbol(region_wide(spark, sf)))


@query("vendor_failures", "SELECT DISTINCT r_name AS security_id FROM region WHERE r_name = 'ASIA'")
def _(spark, sf):
    asked = tb.read(spark, sf, "region").select(F.col("r_name").alias("security_id"))
    return text.failed_symbols(asked, text.assemble_prices(text.split_by_symbol(region_wide(spark, sf))))


block("t_sic", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {lo}, {hi}, '{s}')" for i, (lo, hi, s) in enumerate(sic.SIC_RANGES)) + ") v(i, lo, hi, sector)")


@query("sic_sectors", """
SELECT o_orderkey, (SELECT arg_min(sector, i) FROM t_sic WHERE o_orderkey % 9000 BETWEEN lo AND hi AND o_orderkey % 11 <> 0) AS sector_id FROM orders""")
def _(spark, sf):
    code = F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise((F.col("o_orderkey") % 9000).cast("string"))
    return sic.with_sic_sector(tb.read(spark, sf, "orders").select("o_orderkey", code.alias("sic"))).drop("sic")


@query("reused_tickers", """
SELECT o_orderkey FROM orders WHERE NOT regexp_matches('T' || o_custkey || '-' || CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE 'X' END, '-[0-9]{6}$')""")
def _(spark, sf):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise("X")
    tagged = tb.read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("T"), F.col("o_custkey").cast("string"), F.lit("-"), suffix).alias("t"))
    return tagged.where(~sc.is_reused_ticker("t")).select("o_orderkey")


@query("business_day_age", """
SELECT day, security_id, (SELECT count(*) FROM generate_series(day, DATE '2001-12-14', INTERVAL 1 DAY) g(d) WHERE d < DATE '2001-12-14' AND isodow(d) < 6) AS age, round((epoch(TIMESTAMP '2001-12-14') - epoch(CAST(day AS TIMESTAMP))) / 3600.0::DOUBLE, 3) AS hours
FROM (SELECT security_id, max(day) AS day FROM t_lines GROUP BY 1)""")
def _(spark, sf):
    last = tb.lines(spark, sf).groupBy("security_id").agg(F.max("day").alias("day"))
    now = F.lit("2001-12-14").cast("date")
    return rounded(last.select("day", "security_id", sc.business_days_between("day", now).alias("age"),
                               sc.age_hours("day", now).alias("hours")), 3)


@query("event_payloads", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, substr(sha256(props), 1, 16) AS hash, CASE WHEN value >= 100 THEN 'ALERT' WHEN value >= 50 THEN 'WARN' ELSE 'OK' END AS status FROM events""")
def _(spark, sf):
    e = tb.read(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), sc.content_hash("props").alias("hash"),
                    sc.threshold_status("value", 50, 100).alias("status"))


# ---------------------------------------------------------------- membership histories
@query("membership_intervals", "SELECT security_id, start_date, end_date FROM t_members")
def _(spark, sf):
    return pl.membership(spark, sf).select("security_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"))


@query("customer_membership", """
WITH s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS date FROM orders)),
m AS (SELECT DISTINCT o_custkey AS security_id, last_day(CAST(o_orderdate AS DATE)) AS date FROM orders),
g AS (SELECT m.security_id, min(s.i) AS a, max(s.i) AS b FROM (SELECT m.security_id, s.i, s.i - row_number() OVER (PARTITION BY m.security_id ORDER BY s.i) AS isl FROM m JOIN s USING (date)) m JOIN s ON s.i = m.i GROUP BY m.security_id, m.isl)
SELECT security_id, CASE WHEN a > 0 THEN (SELECT date FROM s WHERE i = a) END AS start_date, (SELECT date FROM s WHERE i = b + 1) AS end_date FROM g""")
def _(spark, sf):
    long = tb.read(spark, sf, "orders").select(F.last_day("o_orderdate").alias("date"), F.col("o_custkey").alias("security_id"))
    return iv.membership_from_snapshots(long).select("security_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"))


def change_log(spark, sf):
    """Monthly entries and exits of the composition, as a change log."""
    m = pl.membership(spark, sf)
    none = F.lit(None).cast("bigint")
    return m.where("start is not null").select(F.col("start").alias("date"), F.col("security_id").alias("added"), none.alias("removed")).unionByName(
        m.where("end is not null").select(F.col("end").alias("date"), none.alias("added"), F.col("security_id").alias("removed")))


@query("membership_from_changes", "SELECT security_id, start_date, end_date FROM t_members")
def _(spark, sf):
    """Rebuilding the intervals from their own change log gives them back."""
    current = pl.membership(spark, sf).where("end is null").select("security_id")
    out = iv.membership_from_changes(current, staged(spark, sf, "change_log", lambda: change_log(spark, sf)))
    return out.select("security_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"))


@query("membership_reconciled", """
WITH cur AS (SELECT security_id FROM t_securities WHERE security_id % 4 <> 0)
SELECT m.security_id, m.start_date, CASE WHEN m.end_date IS NULL AND c.security_id IS NULL THEN DATE '2001-12-31' ELSE m.end_date END AS end_date FROM t_members m LEFT JOIN cur c USING (security_id)
UNION ALL SELECT security_id, DATE '2001-12-31', NULL FROM cur WHERE security_id NOT IN (SELECT security_id FROM t_members WHERE end_date IS NULL)""")
def _(spark, sf):
    current = tb.securities(spark, sf).where("security_id % 4 <> 0").select("security_id")
    out = iv.reconcile_with_current(pl.membership(spark, sf), current, "2001-12-31")
    return out.select("security_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"))


@query("membership_best_source", """
SELECT security_id, start_date, end_date, 'composition history' AS source FROM t_members WHERE end_date IS NULL OR end_date > DATE '1999-01-31'""")
def _(spark, sf):
    m = pl.membership(spark, sf)
    best = iv.best_source([("daily history", m.where("start > end")), ("composition history", m), ("current members only", m.where("end is null"))])
    out = iv.membership_window(best, "1999-01-31")
    return out.select("security_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "source")


@query("recycled_tickers", """
SELECT * FROM (SELECT p.security_id, min(p.date) AS first_price, (SELECT max(m.end_date) FROM t_members m WHERE m.security_id = p.security_id) AS last_end
  FROM t_prices p JOIN t_securities s USING (security_id)
  WHERE s.sector_id <> 'ASIA' OR p.date >= coalesce((SELECT max(m.end_date) FROM t_members m WHERE m.security_id = p.security_id), p.date) GROUP BY 1)
WHERE first_price >= last_end AND security_id NOT IN (SELECT security_id FROM t_members WHERE end_date IS NULL)""")
def _(spark, sf):
    """The vendor's series of one sector's names begin where their memberships end, as those of a
    later company under the same ticker would."""
    members = pl.membership(spark, sf)
    ends = members.groupBy("security_id").agg(F.max("end").alias("_end"))
    sector = tb.securities(spark, sf).select("security_id", "sector_id")
    prices = tb.prices(spark, sf).join(sector, "security_id").join(ends, "security_id", "left")
    later = (F.col("sector_id") != "ASIA") | (F.col("date") >= F.coalesce("_end", "date"))
    return iv.recycled_tickers(prices.where(later).drop("sector_id", "_end"), members)


def newest(spark, sf):
    """Prices of the last date of the calendar."""
    return tb.prices(spark, sf).where(F.col("pos") == tb.last_position(tb.calendar(spark, sf)))


@query("missing_members", """
SELECT count(*) AS members, count(*) FILTER (WHERE n = 0) AS missing, count(*) FILTER (WHERE n = 0) <= 0.05 * count(*) AS acceptable
FROM (SELECT s.security_id, (SELECT count(*) FROM t_prices p WHERE p.security_id = s.security_id AND p.pos = (SELECT max(pos) FROM t_calendar)) AS n FROM t_securities s)""")
def _(spark, sf):
    return iv.missing_members(tb.securities(spark, sf), newest(spark, sf))


@query("coverage_by_year", """
WITH y AS (SELECT DISTINCT year(date) AS year, make_date(year(date), 12, 31) AS d FROM t_calendar),
m AS (SELECT DISTINCT y.year, m.security_id FROM y JOIN t_members m ON (m.start_date IS NULL OR m.start_date <= y.d) AND (m.end_date IS NULL OR m.end_date > y.d))
SELECT year, count(*) AS members, round(avg(CASE WHEN p THEN 1.0::DOUBLE ELSE 0 END), 6) AS with_prices, round(avg(CASE WHEN p AND f THEN 1.0::DOUBLE ELSE 0 END), 6) AS with_prices_and_fundamentals
FROM (SELECT year, security_id, security_id IN (SELECT security_id FROM t_prices) AS p, security_id IN (SELECT security_id FROM t_fundamentals) AS f FROM m) GROUP BY 1""")
def _(spark, sf):
    df = iv.coverage_by_year(tb.calendar(spark, sf), pl.membership(spark, sf), tb.prices(spark, sf), tb.fundamentals(spark, sf))
    return rounded(df)


@query("company_id_resolution", """
SELECT s_suppkey AS security_id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN s_suppkey * 10 WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN s_suppkey * 100
    WHEN s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0 THEN s_suppkey * 100 WHEN s_suppkey % 7 = 0 THEN s_suppkey * 1000 WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 100 END AS cik,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'wikipedia' WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'sec_ticker'
    WHEN s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0 THEN 'sec_ticker_name_checked' WHEN s_suppkey % 7 = 0 THEN 'sec_name_lookup' WHEN s_suppkey % 5 <> 0 THEN 'sec_ticker_unverified' ELSE 'unresolved' END AS method
FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    base = tb.read(spark, sf, "supplier")
    name = F.when(k % 7 == 0, F.concat("s_name", F.lit(" Corp.")))
    secs = base.select(k.alias("security_id"), (k % 2 == 0).alias("is_current"), F.when(k % 3 == 0, k * 10).alias("listed_cik"),
                       name.alias("removed_name"), sc.normalize_company_name(name).alias("removed_key"))
    tickers = base.where(k % 5 != 0).select(k.alias("security_id"), (k * 100).alias("ticker_cik"), F.concat("s_name", F.lit(" Inc")).alias("ticker_title"))
    names = text.unique_names(base.select(sc.normalize_company_name("s_name").alias("name_key"), (k * 1000).alias("cik")))
    return iv.resolve_company_ids(secs, tickers, names)


@query("score_contract", """
SELECT check_name AS check, violations FROM (
  SELECT 'sector_id is null' AS check_name, count(*) FILTER (WHERE sector_id IS NULL) AS violations FROM t_signals
  UNION ALL SELECT 'duplicate primary keys (as_of_date, security_id)', count(*) - count(DISTINCT (as_of_date, security_id)) FROM t_signals
  UNION ALL SELECT 'as_of_date in the future', count(*) FILTER (WHERE as_of_date > DATE '2000-06-30') FROM t_signals
  UNION ALL SELECT 'fundamentals_available_at > as_of_date (look-ahead)', count(*) FILTER (WHERE fundamentals_available_at > DATE '2000-06-30') FROM t_signals
  UNION ALL SELECT 'estimates_available_at > as_of_date (look-ahead)', count(*) FILTER (WHERE estimates_available_at > DATE '2000-06-30') FROM t_signals
  UNION ALL """ + " UNION ALL ".join(f"SELECT '{c} outside [0, 100]', count(*) FILTER (WHERE {c} < 0 OR {c} > 100) FROM t_signals"
                                    for c in contracts.REQUIRED if c.endswith("_score")) + ")")
def _(spark, sf):
    return contracts.validate_factor_scores(pl.signals(spark, sf), "2000-06-30")
