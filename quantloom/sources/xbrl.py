"""Company facts (nested JSON) to quarterly point-in-time statements and share counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accepted filing forms, period lengths in days, and for each measure the
# concepts that may report it, best first.
FORMS = ("10-Q", "10-K", "10-Q/A", "10-K/A", "10-KT", "10-QT")
QUARTER_DAYS = (75, 105)
ANNUAL_DAYS = (340, 390)
FLOW_CONCEPTS = {
    "revenue": (
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
    ),
    "gross_profit": ("GrossProfit",),
    "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"),
    "operating_income": ("OperatingIncomeLoss",),
    "depreciation": (
        "DepreciationDepletionAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization",
        "Depreciation",
    ),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_cash_flow": (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
}
INSTANT_CONCEPTS = {
    "cash": (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        "Cash",
    ),
    "long_term_debt": ("LongTermDebt", "LongTermDebtNoncurrent"),
    "current_debt": ("DebtCurrent", "LongTermDebtCurrent"),
    "short_term_borrowings": ("ShortTermBorrowings", "CommercialPaper"),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
}
SHARE_CONCEPT = "WeightedAverageNumberOfDilutedSharesOutstanding"
COVER_SHARE_CONCEPT = "EntityCommonStockSharesOutstanding"

SCHEMA = (
    "facts map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, end: string, val: string, filed: string, form: string>>>>>>"
)


def fact_rows(documents: DataFrame, key: str = "security_id", text: str = "document") -> DataFrame:
    """Every reported fact as a row; dates and numbers that cannot be read are null."""
    parsed = documents.select(key, F.from_json(text, SCHEMA).alias("_d"))
    taxonomy = parsed.select(key, F.explode("_d.facts").alias("taxonomy", "_c"))
    concept = taxonomy.select(key, "taxonomy", F.explode("_c").alias("concept", "_u"))
    unit = concept.select(key, "taxonomy", "concept", F.explode("_u.units").alias("unit", "_f"))
    fact = unit.select(key, "taxonomy", "concept", "unit", F.posexplode("_f").alias("_place", "_r"))
    return fact.select(
        key,
        "taxonomy",
        "concept",
        "unit",
        "_place",
        F.to_date("_r.start").alias("start"),
        F.to_date("_r.end").alias("end"),
        F.expr("try_cast(_r.val as double)").alias("val"),
        F.to_date("_r.filed").alias("filed"),
        F.col("_r.form").alias("form"),
    )


def first_filed(facts: DataFrame, key: str = "security_id") -> DataFrame:
    """The first filed value of each period; later restatements never leak backwards."""
    accepted = facts.where(F.col("form").isin(*FORMS))
    best = F.min_by(F.struct("val", "filed"), F.struct("filed", "_place"))
    return (
        accepted.groupBy(key, "taxonomy", "concept", "unit", "start", "end")
        .agg(best.alias("_b"))
        .select(key, "taxonomy", "concept", "unit", "start", "end", "_b.val", "_b.filed")
    )


def quarterly_flows(facts: DataFrame, key: str = "security_id") -> DataFrame:
    """Quarterly values of duration concepts: three-month facts, else year-to-date differences.

    A year-to-date chain shares its start date and spans at most 390 days, which bounds the
    window. A direct fact wins; between chains the earliest start wins.
    """
    days = F.datediff("end", "start")
    spans = facts.where("start is not null").withColumn("_days", days)
    series = [key, "concept", "unit"]
    direct = spans.where(F.col("_days").between(*QUARTER_DAYS)).select(
        *series,
        "end",
        F.col("val").alias("value"),
        F.col("filed").alias("available_at"),
        # Of several starts the one filed last counts.
        F.struct(F.lit(0).alias("c"), (-F.unix_date("filed")).alias("o")).alias("_order"),
    )
    chain = Window.partitionBy(*series, "start").orderBy("end")
    gap = F.datediff("end", F.lag("end").over(chain))
    stepped = spans.where(F.col("_days") <= ANNUAL_DAYS[1]).select(
        *series,
        "start",
        "end",
        gap.alias("_gap"),
        (F.col("val") - F.lag("val").over(chain)).alias("value"),
        F.greatest("filed", F.lag("filed").over(chain)).alias("available_at"),
    )
    derived = stepped.where(F.col("_gap").between(*QUARTER_DAYS)).select(
        *series,
        "end",
        "value",
        "available_at",
        F.struct(F.lit(1).alias("c"), F.unix_date("start").alias("o")).alias("_order"),
    )
    best = F.min_by(F.struct("value", "available_at"), F.col("_order"))
    return direct.unionByName(derived).groupBy(*series, "end").agg(best.alias("_b")).select(
        *series, "end", "_b.*"
    )


def instant_values(facts: DataFrame, key: str = "security_id") -> DataFrame:
    return facts.where("start is null").select(
        key, "concept", "unit", "end", F.col("val").alias("value"), F.col("filed").alias("available_at")
    )


def concept_table(spark, concepts: dict) -> DataFrame:
    rows = [(m, c, i) for m, cs in concepts.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "measure string, concept string, priority int")


def first_available(series: DataFrame, concepts: dict, key: str = "security_id") -> DataFrame:
    """One series per measure: for every period the best concept that reports it."""
    table = F.broadcast(concept_table(series.sparkSession, concepts))  # about 30 fixed rows
    best = F.min_by(F.struct("value", "available_at"), F.col("priority"))
    return (
        series.where("unit = 'USD'")
        .join(table, "concept")
        .groupBy(key, "measure", "end")
        .agg(best.alias("_b"))
        .select(key, "measure", "end", "_b.*")
    )


def statements(facts: DataFrame, key: str = "security_id", tolerance_days: int = 7) -> DataFrame:
    """Quarterly statements at the revenue dates; other lines may be a week off.

    Each line is offered to the days it can serve and meets the revenue dates by equality; the
    nearest wins, the earlier of two equally near.
    """
    gaap = facts.where("taxonomy = 'us-gaap'")
    kept = first_filed(gaap, key)
    flows = first_available(quarterly_flows(kept, key), FLOW_CONCEPTS, key)
    lines = flows.unionByName(first_available(instant_values(kept, key), INSTANT_CONCEPTS, key))
    base = flows.where("measure = 'revenue'").select(key, F.col("end").alias("day"))
    reach = F.sequence(F.date_sub("end", tolerance_days), F.date_add("end", tolerance_days))
    offers = lines.withColumn("day", F.explode(reach)).withColumn(
        "_far", F.struct(F.abs(F.datediff("end", "day")).alias("d"), "end")
    )
    measures = [*FLOW_CONCEPTS, *INSTANT_CONCEPTS]

    def nearest(m: str) -> Column:
        here = F.col("measure") == m
        pick = F.struct("value", "available_at")
        return F.min_by(F.when(here, pick), F.when(here, F.col("_far"))).alias(m)

    wide = base.join(offers, [key, "day"]).groupBy(key, "day").agg(*[nearest(m) for m in measures])
    capex_names = list(FLOW_CONCEPTS["capex"])
    reports = gaap.groupBy(key).agg(
        F.bool_or(F.col("concept").isin(capex_names)).alias("_reports_capex")
    )
    v = {m: F.col(f"{m}.value") for m in measures}
    zero = F.lit(0.0)
    capex = F.when(F.col("_reports_capex"), v["capex"]).otherwise(F.coalesce(v["capex"], zero))
    parts = [v["long_term_debt"], v["current_debt"], v["short_term_borrowings"]]
    debt = F.when(F.coalesce(*parts).isNotNull(), sum([F.coalesce(p, zero) for p in parts], zero))
    cash = F.coalesce(v["cash"], zero)
    available = F.greatest(*[F.col(f"{m}.available_at") for m in measures])
    return (
        wide.join(reports, key)
        .select(
            key,
            F.col("day").alias("event_time"),
            available.alias("available_at"),
            v["revenue"].alias("revenue"),
            F.coalesce(v["gross_profit"], v["revenue"] - v["cost_of_revenue"]).alias("gross_profit"),
            (v["operating_income"] + v["depreciation"]).alias("ebitda"),
            v["net_income"].alias("net_income"),
            (v["operating_cash_flow"] - capex).alias("free_cash_flow"),
            (v["equity"] + F.coalesce(debt, zero) - cash).alias("invested_capital"),
            (debt - cash).alias("net_debt"),
        )
        .where("available_at is not null")
    )


def share_counts(facts: DataFrame, key: str = "security_id") -> DataFrame:
    """Diluted average shares with filing dates; filers without them use the cover page."""
    gaap = first_filed(facts.where(f"taxonomy = 'us-gaap' and concept = '{SHARE_CONCEPT}' and unit = 'shares'"), key)
    has_duration = gaap.where("start is not null").select(key).distinct()
    days = F.datediff("end", "start")
    own = gaap.where(days.between(QUARTER_DAYS[0], ANNUAL_DAYS[1])).select(key, "end", "val", "filed", F.unix_date("start").alias("_o"))
    cover = facts.where(
        (F.col("taxonomy") == "dei") & (F.col("concept") == COVER_SHARE_CONCEPT) & (F.col("unit") == "shares") & F.col("form").isin(*FORMS)
    ).join(has_duration, key, "left_anti").select(key, "end", "val", "filed", F.col("_place").alias("_o"))
    best = F.min_by(F.struct("val", "filed"), F.struct("filed", "_o"))
    both = own.unionByName(cover).groupBy(key, "end").agg(best.alias("_b"))
    return both.select(
        key, F.col("_b.filed").alias("available_at"), F.col("_b.val").alias("shares_outstanding")
    ).dropna()
