"""Trailing-twelve-month statements, growth, revisions and the full feature snapshot.

The statements visible to a decision only change when a filing appears, so the aggregates are
computed once per *filing date* of a security and then carried to the decision dates by an
as-of join. That replaces the (decision date x quarter) range join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import DAILY, Bars
from quantloom.functions.scalars import finite, ratio, ratio_positive
from quantloom.operators.asof import Facts, asof_join_many, members_at
from quantloom.operators.series import price_features

# Measures that are summed over four quarters, and the windows in days.
FLOWS = ("revenue", "gross_profit", "ebitda", "net_income", "free_cash_flow")
TTM_DAYS = 300
YEAR_AGO_DAYS = (330, 400)
MARGIN_DAYS = 650
MIN_MARGIN_QUARTERS = 6

STATE_COLUMNS = (
    *[f"ttm_{c}" for c in FLOWS],
    "net_debt",
    "invested_capital",
    "latest_revenue",
    "latest_net_income",
    "prev_revenue",
    "prev_net_income",
    "prev_invested_capital",
    "gross_margin_volatility",
    "earnings_volatility",
    "fundamentals_available_at",
)


def filing_states(facts: DataFrame) -> DataFrame:
    """One row per security and filing date: everything known once that filing is out.

    A state looks back at most 650 days from its newest quarter. Statements are dealt by security
    once; states meet them, and are folded, where they lie.
    """
    # In order of time, so that sums of doubles do not depend on how rows arrive.
    facts = facts.repartition("security_id").sortWithinPartitions("security_id", "event_time", "available_at")
    so_far = (
        Window.partitionBy("security_id")
        .orderBy("available_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    states = (
        facts.select("security_id", "available_at", "event_time")
        .groupBy("security_id", "available_at")
        .agg(F.max("event_time").alias("event_time"))
        .select(
            "security_id",
            F.col("available_at").alias("known_at"),
            F.max("event_time").over(so_far).alias("newest"),
        )
    )
    reach = max(TTM_DAYS, YEAR_AGO_DAYS[1], MARGIN_DAYS)
    seen = states.join(facts, "security_id").where(
        (F.col("available_at") <= F.col("known_at"))
        & (F.col("event_time") <= F.col("newest"))
        & (F.col("event_time") >= F.date_sub("newest", reach))
    )
    age = F.datediff("newest", "event_time")
    ttm, now = age <= TTM_DAYS, age == 0
    before, margins = age.between(*YEAR_AGO_DAYS), age <= MARGIN_DAYS
    order = F.struct("event_time", "available_at")

    def newest(c: str, where: Column) -> Column:
        # The struct keeps a null value of the newest row, as a plain max_by would skip none.
        picked = F.max_by(F.when(where, F.struct(F.col(c))), F.when(where, order))
        return picked.getField(c)

    revenue = F.when(F.col("revenue") > 0, F.col("revenue"))
    enough = F.count_if(margins) >= MIN_MARGIN_QUARTERS
    complete = F.count_if(ttm) == 4
    folded = seen.groupBy("security_id", "known_at").agg(
        complete.alias("_complete"),
        *[
            F.when(F.count(F.when(ttm, F.col(c))) >= 4, F.sum(F.when(ttm, F.col(c)))).alias(
                f"ttm_{c}"
            )
            for c in FLOWS
        ],
        newest("net_debt", now).alias("net_debt"),
        newest("invested_capital", now).alias("invested_capital"),
        newest("revenue", now).alias("latest_revenue"),
        newest("net_income", now).alias("latest_net_income"),
        newest("revenue", before).alias("prev_revenue"),
        newest("net_income", before).alias("prev_net_income"),
        newest("invested_capital", before).alias("prev_invested_capital"),
        F.when(
            enough, F.stddev_samp(F.when(margins, F.col("gross_profit") / revenue))
        ).alias("gross_margin_volatility"),
        F.when(enough, F.stddev_samp(F.when(margins, F.col("net_income") / revenue))).alias(
            "earnings_volatility"
        ),
        newest("available_at", now).alias("fundamentals_available_at"),
    )
    return folded.select(
        "security_id",
        F.col("known_at").alias("available_at"),
        *[F.when(F.col("_complete"), F.col(c)).alias(c) for c in STATE_COLUMNS],
    )


def ratio_features(df: DataFrame, market_cap: str = "market_cap_usd") -> DataFrame:
    """Valuation, quality and growth ratios from a row that carries a filing state."""
    cap = F.col(market_cap)
    capital = F.col("invested_capital")
    features = {
        "earnings_yield": ratio("ttm_net_income", cap),
        "fcf_yield": ratio("ttm_free_cash_flow", cap),
        "ev_ebitda": ratio_positive(cap + F.col("net_debt"), "ttm_ebitda"),
        "roic": ratio_positive("ttm_net_income", capital),
        "gross_margin": ratio_positive("ttm_gross_profit", "ttm_revenue"),
        "fcf_margin": ratio_positive("ttm_free_cash_flow", "ttm_revenue"),
        "net_debt_ebitda": ratio_positive("net_debt", "ttm_ebitda"),
        "revenue_growth": ratio_positive("latest_revenue", "prev_revenue") - 1.0,
        "eps_growth": ratio_positive("latest_net_income", "prev_net_income") - 1.0,
        "sales_yield": ratio("ttm_revenue", cap),
        "gross_profitability": ratio_positive("ttm_gross_profit", capital),
        "accruals": ratio_positive(
            F.col("ttm_net_income") - F.col("ttm_free_cash_flow"), capital
        ),
        "asset_growth": ratio_positive(capital, "prev_invested_capital") - 1.0,
    }
    keep = [c for c in df.columns if c not in STATE_COLUMNS]
    rest = ("gross_margin_volatility", "earnings_volatility", "fundamentals_available_at")
    return df.select(*keep, *[finite(x).alias(n) for n, x in features.items()], *rest)


def known_shares(shares: DataFrame) -> DataFrame:
    return shares.where("shares_outstanding is not null")


def share_sources(shares: DataFrame, issuance_days: int = 365) -> list[Facts]:
    """Share count now and ``issuance_days`` earlier, for :func:`asof_join_many`."""
    known, columns = known_shares(shares), ["shares_outstanding"]
    return [
        Facts(known, columns, tie=columns),
        Facts(known, columns, prefix="past_", lag_days=issuance_days, tie=columns),
    ]


def net_issuance() -> Column:
    """Relative change of the share count; the earlier count must be positive."""
    return ratio_positive("shares_outstanding", "past_shares_outstanding") - 1.0


def estimate_sources(estimates: DataFrame, short_days: int = 30, long_days: int = 90):
    columns = ["fy1_eps_estimate"]
    dated = estimates.withColumn("estimates_available_at", F.col("available_at"))
    return [
        Facts(dated, [*columns, "estimates_available_at"], tie=columns),
        Facts(dated, columns, prefix="short_", lag_days=short_days, tie=columns),
        Facts(dated, columns, prefix="long_", lag_days=long_days, tie=columns),
    ]


def revision_ratios(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Estimate changes over both lags and the share of upward revisions.

    ``df`` carries the columns of :func:`estimate_sources`, ``counts`` those of
    :func:`window_sums` (without them ``df`` has them already).
    """
    up, down = F.col("n_revisions_up"), F.col("n_revisions_down")
    working = (
        "fy1_eps_estimate", "short_fy1_eps_estimate", "long_fy1_eps_estimate", "n_revisions_up", "n_revisions_down",
    )
    kept = [c for c in df.columns if c not in working]
    joined = df if counts is None else df.join(counts, ["security_id", "as_of_date"], "left")
    return joined.select(
        *kept,
        (ratio("fy1_eps_estimate", "short_fy1_eps_estimate") - 1.0).alias("eps_rev_30d"),
        (ratio("fy1_eps_estimate", "long_fy1_eps_estimate") - 1.0).alias("eps_rev_90d"),
        F.when(F.col("estimates_available_at").isNotNull(), ratio(up, up + down)).alias(
            "revisions_up_ratio"
        ),
    )


def window_sums(
    dates: DataFrame, facts: DataFrame, columns: list[str], days: int
) -> DataFrame:
    """Sums over ``(date - days, date]`` per security and decision date.

    Facts are folded per day, and each day is offered to the decision dates that can see it
    (an equality join with the exploded look-back of the bounded schedule). Facts are dealt by
    security once and added up where they lie.
    """
    reach = dates.select(
        "as_of_date",
        F.explode(F.sequence(F.date_sub("as_of_date", days - 1), "as_of_date")).alias(
            "available_at"
        ),
    )
    dealt = facts.select("security_id", "available_at", *columns).repartition("security_id")
    daily = dealt.groupBy("security_id", "available_at").agg(*[F.sum(c).alias(c) for c in columns])
    return (
        daily.join(F.broadcast(reach), "available_at")
        .groupBy("security_id", "as_of_date")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )


def feature_snapshot(
    grid: DataFrame,
    securities: DataFrame,
    decision_dates: DataFrame,
    fundamentals: DataFrame | None = None,
    estimates: DataFrame | None = None,
    shares: DataFrame | None = None,
    membership: DataFrame | None = None,
    benchmark: DataFrame | None = None,
    bars: Bars = DAILY,
    data_version: str = "",
    revision_days: tuple[int, int] = (30, 90),
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Point-in-time features for every ``(decision date, security)``.

    Only data with ``available_at`` up to the decision date and prices up to its close are
    read. Tables that are not given leave their features out, and the scorer treats missing
    columns as missing values.

    All of it is one job by security: price features, statements and counts are dealt by security
    once, and windows, folds and the as-of join run where their rows lie. ``materialize`` is applied
    to the price features where nothing is joined to them.
    """
    priced = price_features(grid, benchmark, bars)
    dropped = ("pos", "open", "high", "low", "close", "price_close", "volume", "ret")
    # Decision dates are a subset of the trading calendar, hence bounded.
    out = priced.drop(*dropped).join(
        F.broadcast(decision_dates.select(F.col("as_of_date").alias("date"))), "date", "left_semi"
    ).withColumnRenamed("date", "as_of_date")
    sources = share_sources(shares) if shares is not None else []
    if fundamentals is not None:
        sources.append(Facts(filing_states(fundamentals), STATE_COLUMNS, dealt=True))
    if estimates is not None:
        columns = ["n_revisions_up", "n_revisions_down"]
        counts = window_sums(decision_dates, estimates, columns, revision_days[0])
        sources.extend(estimate_sources(estimates, *revision_days))
        sources.append(Facts(counts, columns, time="as_of_date", exact=True, dealt=True))
    if membership is not None:
        live = members_at(decision_dates, membership).withColumn("in_universe", F.lit(True))
        sources.append(Facts(live, ["in_universe"], time="as_of_date", exact=True, dealt=True))
    out = asof_join_many(out, sources, decision_dates) if sources else materialize(out)
    if shares is not None:
        out = out.withColumn("net_issuance_1y", net_issuance()).drop("past_shares_outstanding")
    elif "shares_outstanding" in securities.columns:
        static = securities.select("security_id", "shares_outstanding")
        out = out.join(static, "security_id", "left")
    else:
        out = out.withColumn("shares_outstanding", F.lit(None).cast("double"))
    cap = F.col("price") * F.col("shares_outstanding")
    out = out.withColumn("market_cap_usd", cap).withColumn(
        "log_market_cap", F.when(F.col("market_cap_usd") > 0, F.ln("market_cap_usd"))
    )
    if fundamentals is not None:
        out = ratio_features(out)
    if estimates is not None:
        out = revision_ratios(out)
    if membership is not None:
        out = out.withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))
    names = securities.select(
        "security_id", *[c for c in ("ticker", "sector_id", "industry_id") if c in securities.columns]
    )
    return out.join(names, "security_id").withColumn("data_version", F.lit(data_version))
