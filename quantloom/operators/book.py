"""Ledger tables: positions from fills, reconciliation, pre-trade checks, book views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def implied_positions(fills: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Signed quantity per security over every fill (combines map-side; works on streams)."""
    summed = fills.groupBy("security_id").agg(F.sum("qty").alias("qty"))
    return summed.where(F.abs("qty") > tolerance)


def filled_quantities(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Absolute quantity filled per order, zero when nothing was."""
    done = fills.groupBy("order_id").agg(F.sum(F.abs("qty")).alias("filled_qty"))
    return orders.join(done, "order_id", "left").withColumn(
        "filled_qty", F.coalesce("filled_qty", F.lit(0.0))
    )


def execution_summary(orders: DataFrame, keys: Sequence[str] = ("proposal_id",)) -> DataFrame:
    """Orders filled, submitted and rejected per proposal, and the status that follows."""
    filled, rejected = F.col("status") == "FILLED", F.col("status") == "REJECTED"
    counts = orders.groupBy(*keys).agg(
        F.count_if(filled).alias("filled"),
        F.count_if(~filled & ~rejected).alias("submitted"),
        F.count_if(rejected).alias("rejected"),
        F.count(F.lit(1)).alias("_n"),
    )
    status = (
        F.when(F.col("filled") == F.col("_n"), "EXECUTED")
        .when(F.col("filled") + F.col("submitted") == 0, "FAILED")
        .otherwise("PARTIALLY_EXECUTED")
    )
    return counts.withColumn("status", status).drop("_n")


def reconcile(broker: DataFrame, ledger: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Positions that differ between broker and ledger."""
    b = broker.select("security_id", F.col("qty").alias("broker"))
    own = ledger.select("security_id", F.col("qty").alias("_ledger"))
    both = b.join(own, "security_id", "full_outer").withColumns(
        {"broker": F.coalesce("broker", F.lit(0.0)), "ledger": F.coalesce("_ledger", F.lit(0.0))}
    )
    kind = F.when(F.col("_ledger").isNull(), "UNTRACKED_AT_BROKER").otherwise("QUANTITY_MISMATCH")
    return both.where(F.abs(F.col("broker") - F.col("ledger")) > tolerance).select(
        "security_id", "broker", "ledger", kind.alias("type")
    )


def book_weights(positions: DataFrame, last_prices: DataFrame, securities: DataFrame, cash: float):
    """Positions valued at the last price, their weight in equity, and whether managed."""
    known = securities.select("security_id", F.lit(True).alias("managed"))
    valued = (
        positions.join(last_prices, "security_id", "left")
        .join(known, "security_id", "left")
        .withColumn("value", F.col("qty") * F.coalesce("price", F.lit(0.0)))
    )
    equity = valued.select((F.sum("value") + F.lit(cash))).scalar()
    return valued.select(
        "security_id",
        "qty",
        "price",
        "value",
        (F.col("value") / equity).alias("weight"),
        F.coalesce("managed", F.lit(False)).alias("managed"),
    )


def last_prices(prices: DataFrame, price: str = "price_close") -> DataFrame:
    known = prices.where(F.col(price).isNotNull())
    return known.groupBy("security_id").agg(F.max_by(price, "date").alias("price"))


def share_step(x: Column) -> Column:
    """Quantities to the ten-thousandth, halves up."""
    return F.floor(x * 10_000.0 + 0.5) / F.lit(10_000.0)


def sized_orders(
    orders: DataFrame,
    prices: DataFrame,
    held: DataFrame,
    keys: Sequence[str],
    equity: float,
    cash_buffer: float = 0.005,
    min_order: float = 25.0,
    max_order_share: float = 0.10,
) -> DataFrame:
    """Traded orders with quantity and the check each fails, if any.

    Buys keep a cash buffer, sells never exceed the holding, exits sell all of it, orders that
    are too small are dropped, and only an exit may pass the size limit. ``prices`` are joined by
    security, and by ``as_of_date`` where they have it.
    """
    keys = list(keys)
    by = [c for c in ("security_id", "as_of_date") if c in prices.columns]
    rows = (
        orders.where("side <> 'HOLD'")
        .join(prices.select(*by, "price"), by, "left")
        .join(held.select(*keys, "security_id", F.col("qty").alias("_held")), [*keys, "security_id"], "left")
    )
    priced = F.col("price") > 0
    raw = F.when(priced, share_step(F.abs(F.col("delta_weight") * equity) / F.col("price")))
    holding = F.coalesce("_held", F.lit(0.0))
    exit_ = (F.col("side") == "SELL") & (F.col("target_weight") <= 0)
    qty = (
        F.when(F.col("side") == "BUY", share_step(raw * (1 - cash_buffer)))
        .when(exit_, holding)
        .otherwise(F.least(raw, holding))
    )
    sized = rows.withColumn("qty", F.when(priced, qty)).withColumn(
        "est_notional", F.col("qty") * F.col("price")
    )
    big = (F.col("est_notional") > max_order_share * equity + 1e-6) & ~exit_
    failed = F.when(F.col("est_notional").isNull(), "PRICE_AVAILABLE").when(big, "MAX_ORDER_SIZE")
    kept = sized.where("est_notional is null or est_notional >= " + str(float(min_order)))
    return kept.select(
        *keys, "security_id", "side", "qty", "price", "est_notional", failed.alias("failed_check")
    )


def pre_trade_checks(
    sized: DataFrame, keys: Sequence[str], max_orders: int = 80, proposals: DataFrame | None = None
) -> DataFrame:
    """Orders and failed checks of each proposal. A proposal all of whose orders were too small has
    no row in ``sized``; listed in ``proposals`` (keys) it passes with no orders."""
    counts = sized.groupBy(*keys).agg(
        F.count_if(F.col("qty").isNotNull()).alias("n_orders"),
        F.count("failed_check").alias("failed_checks"),
    )
    if proposals is not None:
        counts = proposals.select(*keys).distinct().join(counts, list(keys), "left").na.fill(0, ["n_orders", "failed_checks"])
    too_many = F.col("n_orders") > max_orders
    return counts.withColumn("pre_trade_ok", (F.col("failed_checks") == 0) & ~too_many)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*")


def last_rows(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The newest rows, newest first (a top-k report: each task keeps at most ``n``)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def one_per_day(snapshots: DataFrame, at: str, value: str) -> DataFrame:
    return snapshots.groupBy(F.to_date(at).alias("date")).agg(F.max_by(value, at).alias(value))


def audit_trail(df: DataFrame, order: Sequence[str], **equals) -> DataFrame:
    out = df
    for column, wanted in equals.items():
        out = out.where(F.col(column) == F.lit(wanted))
    return out.orderBy(*order)


