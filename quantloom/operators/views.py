"""Read-side tables: rankings, overview, security analysis, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.ranking import group_quantiles, long_form, wide_form
from quantloom.functions.scalars import named_nulls
from quantloom.operators.crosssection import DECISIONS


def decision_counts(signals: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows per date and decision, zero for decisions that do not occur."""
    counted = signals.groupBy(date).agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    )
    return counted.unpivot([date], list(DECISIONS), "decision", "n")


POSITIVE = ("STRONG_LONG", "LONG", "WATCH")


def sector_counts(signals: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Scored names and positive decisions per sector, with the positive share."""
    positive = F.col("decision").isin(*POSITIVE)
    counted = signals.groupBy(date, "sector_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(positive).alias("positive")
    )
    return counted.withColumn("positive_share", F.col("positive") / F.col("count"))


def rankings(signals: DataFrame, as_of, decision: str | None = None, limit: int = 100) -> DataFrame:
    """Best rows of one date, optionally of one decision. The limit is between 1 and 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    day = signals.where(F.col("as_of_date") == as_of)
    kept = day if decision is None else day.where(F.col("decision") == decision)
    return kept.orderBy(F.desc("composite_score"), "security_id").limit(limit)


def filter_rankings(
    ranked: DataFrame,
    decision: str | None = None,
    sector: str | None = None,
    text: str | None = None,
    sort: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """Rows by decision, sector and ticker text; any sort key, unknown values lowest. The
    ``rank`` column is left as it was."""
    out = ranked
    if decision:
        out = out.where(F.col("decision") == decision)
    if sector and sector != "all":
        out = out.where(F.col("sector_id") == sector)
    if text and text.strip():
        out = out.where(F.contains(F.upper("ticker"), F.lit(text.strip().upper())))
    key = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
    return out.orderBy(key, "security_id")


def search_securities(securities: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Tickers or ids that contain the text; those that start with it come first."""
    q = F.lit(text.strip().upper())
    ticker, sid = F.upper("ticker"), F.upper(F.col("security_id").cast("string"))
    found = securities.where(F.contains(ticker, q) | F.contains(sid, q))
    return found.orderBy((~F.startswith(ticker, q)).cast("int"), "ticker").limit(limit)


def sector_medians(signals: DataFrame, families, keys=("as_of_date", "sector_id")) -> DataFrame:
    """Median family score of every sector and date, one column per family (exact)."""
    names = [f"{f}_score" for f in families]
    long = long_form(signals, list(keys), names, "_metric", "_value")
    medians = group_quantiles(long, [*keys, "_metric"], "_value", {"_median": 0.5})
    return wide_form(medians, list(keys), "_metric", "_median", {f"{f}_median": f"{f}_score" for f in families})


def score_changes(signals: DataFrame, calendar: DataFrame, lags) -> DataFrame:
    """Score of every row against the score ``lag`` trading dates earlier, one row per lag.

    Past scores are moved forward to the dates that look back at them; the date pairs are
    bounded by the calendar.
    """
    base = signals.select("as_of_date", "security_id", "composite_score")
    steps = F.explode(F.array(*[F.lit(int(k)).cast("long") for k in lags])).alias("lag")
    now = calendar.select(F.col("date").alias("as_of_date"), F.col("pos").alias("_p"), steps)
    past = calendar.select(F.col("date").alias("past_date"), F.col("pos").alias("_q"))
    pairs = now.join(past, F.col("_p") - F.col("lag") == F.col("_q")).select("as_of_date", "lag", "past_date")
    asked = base.join(F.broadcast(pairs), "as_of_date")
    earlier = base.select(
        F.col("as_of_date").alias("past_date"), "security_id", F.col("composite_score").alias("past_score")
    )
    out = asked.join(earlier, ["past_date", "security_id"], "left")
    return out.withColumn("delta", F.col("composite_score") - F.col("past_score"))


def security_analysis(features: DataFrame, signals: DataFrame, medians: DataFrame, families) -> DataFrame:
    """Everything known about a security on a date: eligibility, returns, scores next to the
    sector's medians, flags, missing inputs and explanation."""
    # Inputs reported when missing.
    listed = (
        "earnings_yield", "fcf_yield", "ev_ebitda", "revenue_growth", "eps_growth", "roic", "gross_margin",
        "fcf_margin", "net_debt_ebitda", "mom_12_1", "eps_rev_30d", "eps_rev_90d", "revisions_up_ratio",
    )
    base = features.withColumn("missing_data", named_nulls([c for c in listed if c in features.columns]))
    scores = signals.select(
        "as_of_date", "security_id", "decision", "composite_score", "composite_percentile",
        *[f"{f}_score" for f in families], "risk_flags", "explanation",
    )
    return base.join(scores, ["as_of_date", "security_id"], "left").join(medians, ["as_of_date", "sector_id"], "left")


def score_history(signals: DataFrame, schedule: DataFrame, securities: DataFrame) -> DataFrame:
    """A row per security and scheduled date; null score and decision where it was not scored."""
    dates = schedule.select(F.sort_array(F.collect_set("as_of_date"))).scalar()  # calendar-bounded
    grid = securities.select("security_id", F.explode(dates).alias("as_of_date"))
    kept = signals.select("as_of_date", "security_id", "composite_score", "composite_percentile", "decision")
    return grid.join(kept, ["as_of_date", "security_id"], "left")


def securities_list(securities: DataFrame, prices: DataFrame) -> DataFrame:
    priced = prices.where("close is not null").select("security_id").distinct()
    flagged = securities.join(priced.withColumn("_p", F.lit(True)), "security_id", "left")
    return flagged.select(
        "security_id", "ticker", "sector_id", F.coalesce("_p", F.lit(False)).alias("has_prices")
    )


def model_portfolio(weights: DataFrame, contributions: DataFrame, signals: DataFrame, securities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdings of every model portfolio with their signal and their share of its risk."""
    keys = list(keys)
    shares = contributions.select(*keys, "security_id", "risk_contribution")
    marks = signals.select("as_of_date", "security_id", "decision", "composite_score", "volatility_63d")
    named = weights.join(securities.select("security_id", "ticker", "sector_id"), "security_id")
    return named.join(shares, [*keys, "security_id"], "left").join(marks, ["as_of_date", "security_id"], "left")


def portfolio_overview(weights: DataFrame, actions: DataFrame, report: DataFrame, breaches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a portfolio: holdings, cash, what risk limits changed, risk and the limits still broken.
    ``actions``: keys and an array ``actions``."""
    keys = list(keys)
    held = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_holdings"), (1.0 - F.sum("weight")).alias("cash_weight"))
    broken = breaches.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("breaches"))
    out = held.join(actions.select(*keys, "actions"), keys, "left").join(report, keys, "left").join(broken, keys, "left")
    return out.withColumn("breaches", F.coalesce("breaches", F.lit(""))).withColumn("actions", F.array_join("actions", ","))


def proposal_summary(orders: DataFrame, before: DataFrame, after: DataFrame, costs: DataFrame, alerts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a proposal: turnover, cost, orders, risk of the book as it is and as it would be, alerts.

    ``before`` and ``after`` are risk reports, ``costs`` has keys and estimated_cost_usd. A book that does
    not exist yet has no risk before; proposals without alerts count none.
    """
    keys = list(keys)
    plan = orders.groupBy(*keys).agg(
        F.sum(F.abs("delta_weight")).alias("estimated_turnover"), F.max("turnover_capped").alias("turnover_capped"),
        F.count_if(F.col("side") != "HOLD").alias("n_orders"),
    )
    measures = ("gross_exposure", "herfindahl", "volatility_annual", "var_95_daily", "beta")
    risk = lambda df, when: df.select(*keys, *(F.col(c).alias(f"{c}_{when}") for c in measures))
    counted = alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_alerts"))
    out = plan.join(costs, keys, "left").join(risk(before, "before"), keys, "left").join(risk(after, "after"), keys, "left").join(counted, keys, "left")
    return out.withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0))).withColumn("status", F.lit("PENDING_APPROVAL"))


def ticker_report(analysis: DataFrame, weights: DataFrame) -> DataFrame:
    """What a report on a security says of every date: whether and why it is not scored, its decision
    and percentile, and its weight in the model portfolio (null where not held)."""
    held = weights.select("as_of_date", "security_id", F.col("weight").alias("model_weight"))
    scored = F.col("eligible") & F.col("decision").isNotNull()
    reason = F.when(F.size("ineligibility_reasons") > 0, F.array_join("ineligibility_reasons", ", ")).otherwise("insufficient fundamental coverage")
    return analysis.join(held, ["as_of_date", "security_id"], "left").withColumn("not_scored", F.when(~scored, reason))
