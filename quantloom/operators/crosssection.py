"""Winsorised group percentiles, eligibility, scores, labels and explanations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import FAMILIES, FAMILY_FEATURES, FEATURES, Eligibility, Strategy, Thresholds
from quantloom.functions.ranking import (
    beside_offsets,
    dealt,
    null_safe_join,
    quantiles_of_ranked,
    value_bucket,
    wide_form,
    with_percentiles,
)

# Decision names in first-match order, and which of them buy or exit.
DECISIONS = ("STRONG_LONG", "LONG", "WATCH", "NEUTRAL", "REDUCE", "AVOID")
BUY = ("STRONG_LONG", "LONG")
EXIT = ("REDUCE", "AVOID")

# Family names in explanation texts.
FAMILY_LABELS = {
    "value": "valoración",
    "growth": "crecimiento",
    "profitability": "rentabilidad/calidad",
    "momentum": "momentum",
    "revisions": "revisiones de EPS",
}


def winsorized_percentiles(
    long: DataFrame,
    groups: Sequence[str],
    value: str = "value",
    sector: str = "sector_id",
    higher_is_better: str | Column | None = None,
    lower: float = 0.01,
    upper: float = 0.99,
    min_group_size: int = 5,
    out: str = "pct",
    with_unknown: bool = True,
) -> DataFrame:
    """``long`` plus the percentile of ``value`` within its sector, clipped at the quantiles of
    the whole group; sectors with few values (or none at all) use the group-wide rank. Rows without
    a value follow with none; ``with_unknown=False`` says that there are none or that nobody wants them.

    Clipping never reorders values: everything at or below the lower quantile becomes one tie,
    likewise at the top. So ranks of the values as they are and two counts a sector are enough.
    The rows are shuffled once, by ``(group, bucket)``: there they meet the offsets of their bucket
    and are ranked in the group and in the sector. The quantiles come from the few buckets that hold them.
    """
    groups = list(groups)
    keys = [*groups, "_bucket"]
    up = F.col(higher_is_better) if isinstance(higher_is_better, str) else higher_is_better
    rows = long.where(F.col(value).isNotNull()).withColumn("_bucket", value_bucket(F.col(value)))
    histogram = rows.groupBy(*groups, sector, "_bucket").agg(F.count(F.lit(1)).alias("_h"))
    offsets = _two_level_offsets(histogram, groups, sector)
    # One row per (date, feature, sector), a fixed classification.
    tails = F.broadcast(_tail_counts(rows, histogram, offsets, groups, sector, value, lower, upper))

    in_group = Window.partitionBy(*keys).orderBy(value)
    in_sector = Window.partitionBy(*keys, sector).orderBy(value)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    placed = beside_offsets(rows, offsets.select(*keys, "_u_before", "_s_before"), keys)
    ranked = placed.select(
        *long.columns,
        "_u_before",
        F.element_at("_s_before", F.col(sector)).alias("_s_before"),
        F.rank().over(in_group).alias("_u_first"),
        F.count(F.lit(1)).over(in_group.rangeBetween(*up_to)).alias("_u_last"),
        F.rank().over(in_sector).alias("_s_first"),
        F.count(F.lit(1)).over(in_sector.rangeBetween(*up_to)).alias("_s_last"),
    )
    scored = null_safe_join(ranked, tails, [*groups, sector], "inner")
    chosen = _clipped(value, sector, up, min_group_size)
    if not with_unknown:
        return scored.select(*long.columns, chosen.alias(out))
    unknown = long.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return scored.select(*long.columns, chosen.alias(out)).unionByName(unknown)


def _clipped(value: str, sector: str, up: Column | None, min_group_size: int) -> Column:
    """The percentile of a row that knows, for its group (``_u_``) and its sector (``_s_``), its place
    and how many values there are, at or below ``_lo`` and at or above ``_hi``."""

    def pct(prefix: str) -> Column:
        n, low, high = (F.col(f"{prefix}{c}") for c in ("n", "low", "high"))
        first, last, before = (F.col(f"{prefix}{c}") for c in ("first", "last", "before"))
        two = F.lit(2.0)
        rank = (
            F.when(F.col("_lo") == F.col("_hi"), (n + 1) / two)
            .when(F.col(value) <= F.col("_lo"), (low + 1) / two)
            .when(F.col(value) >= F.col("_hi"), n - high + (high + 1) / two)
            .otherwise((before + first - 1) + ((last - first + 1) + 1) / two)
        )
        if up is not None:
            rank = F.when(up, rank).otherwise(n + 1 - rank)
        return (rank - 0.5) / n

    own_sector = F.col(sector).isNotNull() & (F.col("_s_n") >= min_group_size)
    return F.when(own_sector, pct("_s_")).otherwise(pct("_u_"))


def _two_level_offsets(histogram: DataFrame, groups: list[str], sector: str) -> DataFrame:
    """A row a (group, bucket): rows of the bucket, below it and in the group, and for each sector
    that occurs in the bucket its rows below it. Sums over a small histogram."""
    below = (Window.unboundedPreceding, -1)
    in_sector = Window.partitionBy(*groups, sector).orderBy("_bucket").rowsBetween(*below)
    parts = histogram.withColumn("_s", F.coalesce(F.sum("_h").over(in_sector), F.lit(0)))
    known = F.when(F.col(sector).isNotNull(), F.struct(F.col(sector), F.col("_s")))
    packed = parts.groupBy(*groups, "_bucket").agg(
        F.sum("_h").alias("_u_h"), F.map_from_entries(F.collect_list(known)).alias("_s_before")
    )
    return packed.select(
        "*",
        F.coalesce(F.sum("_u_h").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(*below)), F.lit(0)).alias("_u_before"),
        F.sum("_u_h").over(Window.partitionBy(*groups)).alias("_u_n"),
    )


def _tail_counts(
    rows: DataFrame, histogram: DataFrame, offsets: DataFrame, groups: list[str], sector: str, value: str, lower: float, upper: float
) -> DataFrame:
    """Per (group, sector): the quantiles ``_lo`` and ``_hi`` of the group, and how many values there
    are, at or below the one, at or above the other, in the sector and in the group."""
    keys = [*groups, "_bucket"]
    holds = F.lit(False)
    for p in (lower, upper):
        place = (F.col("_u_n") - 1) * F.lit(float(p))
        for k in (F.floor(place), F.ceil(place)):
            holds = holds | ((F.col("_u_before") <= k) & (k < F.col("_u_before") + F.col("_u_h")))
    wanted = offsets.where(holds).select(*keys, "_u_before", "_u_n")  # four a group at most
    near = (
        rows.join(F.broadcast(wanted), keys)
        .groupBy(*keys, sector, value, "_u_before", "_u_n")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ordered = Window.partitionBy(*keys).orderBy(value)
    ranked = near.groupBy(*keys, value, "_u_before", "_u_n").agg(F.sum("_n").alias("n_tie")).select(
        *groups,
        value,
        (F.col("_u_before") + F.sum("n_tie").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tie")).alias("n_less"),
        "n_tie",
        F.col("_u_n").alias("n_total"),
    )
    bounds = F.broadcast(quantiles_of_ranked(ranked, groups, value, {"_lo": lower, "_hi": upper}).drop("n_total"))
    # Whole buckets below and above come from the histogram, the bucket of the quantile row by row.
    low_bucket, high_bucket = value_bucket(F.col("_lo")), value_bucket(F.col("_hi"))
    bucket, zero = F.col("_bucket"), F.lit(0)
    whole = histogram.join(bounds, groups).select(
        *groups, sector, "_lo", "_hi", F.col("_h").alias("_n"),
        F.when(bucket < low_bucket, F.col("_h")).otherwise(zero).alias("_low"),
        F.when(bucket > high_bucket, F.col("_h")).otherwise(zero).alias("_high"),
    )
    parts = near.join(bounds, groups).select(
        *groups, sector, "_lo", "_hi", F.lit(0).cast("long").alias("_n"),
        F.when((bucket == low_bucket) & (F.col(value) <= F.col("_lo")), F.col("_n")).otherwise(zero).alias("_low"),
        F.when((bucket == high_bucket) & (F.col(value) >= F.col("_hi")), F.col("_n")).otherwise(zero).alias("_high"),
    )
    sums = whole.unionByName(parts).groupBy(*groups, sector, "_lo", "_hi").agg(
        *[F.sum(f"_{c}").alias(f"_s_{c}") for c in ("n", "low", "high")]
    )
    per_group = Window.partitionBy(*groups)
    return sums.select("*", *[F.sum(f"_s_{c}").over(per_group).alias(f"_u_{c}") for c in ("n", "low", "high")])


def feature_percentiles(
    df: DataFrame,
    features: Mapping[str, bool],
    keys: Sequence[str] = ("as_of_date", "security_id"),
    date: str = "as_of_date",
    sector: str = "sector_id",
    lower: float = 0.01,
    upper: float = 0.99,
    min_group_size: int = 5,
) -> DataFrame:
    """Long ``(keys, factor, pct)`` for every feature present, all features in one pass."""
    present = {f: up for f, up in features.items() if f in df.columns}
    ranked = dealt_percentiles(df, present, keys, date, sector, lower, upper, min_group_size)
    return ranked.select(*keys, F.get(F.array(*map(F.lit, present)), F.col("_f")).alias("factor"), "pct")


# Features of a row that are dealt together.
BLOCK = 7


def dealt_percentiles(
    df: DataFrame,
    features: Mapping[str, bool],
    keys: Sequence[str],
    date: str,
    sector: str,
    lower: float = 0.01,
    upper: float = 0.99,
    min_group_size: int = 5,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`winsorized_percentiles` of the known values of each feature on each date: ``keys``, the
    sector, ``carry``, ``_b`` and ``_f`` (block and place of the feature in the list) and ``pct``.

    A row is dealt once for a block of features, by date and block, with its values packed: it crosses
    the network a few times, not once a feature. Ranks, quantiles and counts are windows over rows that
    lie together from then on; their sorts spill, so a task needs no room for a cross-section.
    """
    names = list(features)
    size = -(-len(names) // max(1, -(-len(names) // BLOCK)))
    packed = F.array(*[
        F.struct(F.lit(at // size).alias("_b"), F.array(*[F.col(c).cast("double") for c in names[at : at + size]]).alias("_v"))
        for at in range(0, len(names), size)
    ])
    kept = [*keys, sector, *carry]
    blocks = df.where(F.col(date).isNotNull()).select(*kept, F.explode(packed).alias("_p")).select(*kept, "_p.*")
    rows = dealt(blocks, date, "_b").select(*kept, "_b", F.posexplode("_v").alias("_i", "_value")).where("_value is not null")
    rows = rows.withColumn("_f", F.col("_b") * size + F.col("_i")).drop("_i")

    group = Window.partitionBy(date, "_b", "_f")
    in_sector = Window.partitionBy(date, "_b", "_f", sector)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    one = F.count(F.lit(1))
    ranked = rows.withColumns(
        {
            "_u_first": F.rank().over(group.orderBy("_value")),
            "_u_last": one.over(group.orderBy("_value").rangeBetween(*up_to)),
            "_u_n": one.over(group),
        }
    )
    bounds = {}
    for name, p in (("_lo", lower), ("_hi", upper)):
        place = (F.col("_u_n") - 1) * F.lit(float(p))
        low, high = (
            F.max(F.when((F.col("_u_first") - 1 <= k) & (k < F.col("_u_last")), F.col("_value"))).over(group)
            for k in (F.floor(place), F.ceil(place))
        )
        bounds[name] = low + (high - low) * (place - F.floor(place))
    placed = ranked.withColumns(bounds).withColumns(
        {
            "_s_first": F.rank().over(in_sector.orderBy("_value")),
            "_s_last": one.over(in_sector.orderBy("_value").rangeBetween(*up_to)),
        }
    )
    at_low, at_high = F.count(F.when(F.col("_value") <= F.col("_lo"), 1)), F.count(F.when(F.col("_value") >= F.col("_hi"), 1))
    counted = placed.withColumns(
        {"_s_n": one.over(in_sector)}
        | {f"{p}low": at_low.over(w) for p, w in (("_s_", in_sector), ("_u_", group))}
        | {f"{p}high": at_high.over(w) for p, w in (("_s_", in_sector), ("_u_", group))}
        | {f"{p}before": F.lit(0) for p in ("_s_", "_u_")}
    )
    up = F.get(F.array(*map(F.lit, features.values())), F.col("_f"))
    return counted.select(*kept, "_b", "_f", _clipped("_value", sector, up, min_group_size).alias("pct"))


def with_eligibility(df: DataFrame, rules: Eligibility) -> DataFrame:
    """``eligible`` and the ordered reasons against; missing data fails a check."""

    def below(c: str, least: float) -> Column:
        return ~F.coalesce(F.col(c) >= F.lit(float(least)), F.lit(False))

    # Reason codes in report order.
    checks = [
        ("PRICE_BELOW_MIN", below("price", rules.minimum_stock_price_usd)),
        ("MARKET_CAP_BELOW_MIN", below("market_cap_usd", rules.min_market_cap_usd)),
        ("ADV_BELOW_MIN", below("adv_usd", rules.min_adv_usd)),
        ("MISSING_SECTOR", F.col("sector_id").isNull()),
    ]
    if "in_universe" in df.columns:
        checks.append(("NOT_IN_UNIVERSE", ~F.coalesce("in_universe", F.lit(False))))
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))
    return df.withColumn("ineligibility_reasons", reasons).withColumn(
        "eligible", F.size("ineligibility_reasons") == 0
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged, or an error naming how many keys occur more than once."""
    repeated = df.groupBy(*keys).count().where("count > 1").count()
    if repeated:
        raise ValueError(f"{repeated} duplicate keys {list(keys)}")
    return df


def family_scores(wide: DataFrame, strategy: Strategy) -> DataFrame:
    """Family scores, coverage and the composite from ``pct_<feature>`` columns.

    A family needs half of its *defined* features; the composite is the weight-renormalised
    mean over available families when they carry enough weight.
    """
    norm, out = strategy.normalization, wide
    zero = F.lit(0.0)
    for family, members in FAMILY_FEATURES.items():
        pcts = [F.col(f"pct_{f}") for f in members if f"pct_{f}" in wide.columns]
        known = sum([F.when(p.isNotNull(), 1).otherwise(0) for p in pcts], F.lit(0))
        total = sum([F.coalesce(p, zero) for p in pcts], zero)
        coverage = known / F.lit(float(len(members)))
        score = F.when(
            (coverage >= norm.min_family_coverage) & (known > 0), 100.0 * (total / known)
        )
        out = out.withColumn(f"{family}_coverage", coverage).withColumn(f"{family}_score", score)
    weight, weighted = zero, zero
    for family in FAMILIES:
        w, s = F.lit(float(strategy.composite_weights[family])), F.col(f"{family}_score")
        weight = weight + F.when(s.isNotNull(), w).otherwise(zero)
        weighted = weighted + F.coalesce(s, zero) * w
    out = out.withColumn("data_coverage", weight)
    # Tolerance of one part in 1e12 for the sum of the weights themselves.
    composite = F.when(
        (F.col("data_coverage") >= norm.min_composite_coverage - 1e-12)
        & (F.col("data_coverage") > 0),
        weighted / F.col("data_coverage"),
    )
    return out.withColumn(
        "composite_score",
        F.when(composite.isNotNull(), F.least(F.greatest(composite, zero), F.lit(100.0))),
    )


def score_columns() -> dict[str, str]:
    names = {"composite_percentile": "composite_score"}
    names.update({f"{f}_percentile": f"{f}_score" for f in FAMILIES})
    return names


def factor_scores(
    features: DataFrame,
    strategy: Strategy,
    keys: Sequence[str] = ("as_of_date", "security_id"),
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Scores of every cross-section in ``features`` (eligible rows only). ``materialize`` is
    applied to the long percentile table, see :func:`feature_snapshot`."""
    missing = [c for c in ("security_id", "sector_id") if c not in features.columns]
    if missing:
        raise ValueError(f"features lack required columns: {missing}")
    wide = wide_percentiles(materialize(strategy_percentiles(features, strategy, keys)), keys)
    return family_scores(features.join(wide, list(keys), "left"), strategy)


def strategy_percentiles(eligible: DataFrame, strategy: Strategy, keys: Sequence[str] = ("as_of_date", "security_id")) -> DataFrame:
    """Percentiles of the strategy's features by its normalization, long."""
    norm = strategy.normalization
    return feature_percentiles(
        eligible,
        FEATURES,
        keys,
        lower=norm.lower_quantile,
        upper=norm.upper_quantile,
        min_group_size=norm.min_group_size,
    )


def wide_percentiles(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wide_form(long, keys, "factor", "pct", {f"pct_{f}": f for f in FEATURES})


# What is ranked beside the scores.
MEASURES = ("adv_usd", "volatility_63d")


def score_rows(
    eligible: DataFrame,
    strategy: Strategy,
    keys: Sequence[str] = ("as_of_date", "security_id"),
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
    percentiles: DataFrame | None = None,
    keep: Sequence[str] = MEASURES,
    detail: bool = False,
) -> DataFrame:
    """Scores, percentiles over the scored universe and the risk flag of ``eligible`` rows, without
    the features they come from: of those only ``keep`` (and ``pct_<feature>`` with ``detail``).

    A feature is read once, for its percentile; ranks and labels move rows of a few numbers.
    ``percentiles`` are those of :func:`strategy_percentiles` where they are known already.
    """
    keys = list(keys)
    long = percentiles if percentiles is not None else materialize(strategy_percentiles(eligible, strategy, keys))
    # A row without a single percentile has no score.
    scored = family_scores(wide_percentiles(long, keys), strategy).where("composite_score is not null")
    if not detail:
        scored = scored.drop(*[c for c in scored.columns if c.startswith("pct_")])
    kept = eligible.select(*keys, *dict.fromkeys([*keep, *MEASURES]))
    ranked = with_percentiles(
        materialize(scored.join(kept, keys)),
        keys[:1],
        keys,
        {
            **score_columns(),
            "liquidity_percentile": "adv_usd",
            "_volatility_percentile": "volatility_63d",
        },
    )
    high = F.coalesce(
        F.col("_volatility_percentile") > strategy.eligibility.max_volatility_percentile,
        F.lit(False),
    )
    return ranked.withColumn("risk_flag", high.cast("int")).drop("_volatility_percentile")


def explained(scored: DataFrame) -> DataFrame:
    """``risk_flags`` and ``explanation`` of :func:`score_rows`, row by row."""
    flags = F.when(F.col("risk_flag") == 1, F.array(F.lit("HIGH_VOLATILITY"))).otherwise(F.array().cast("array<string>"))
    return scored.withColumn("risk_flags", flags).withColumn("explanation", explanation())


def score_universe(
    features: DataFrame,
    strategy: Strategy,
    keys: Sequence[str] = ("as_of_date", "security_id"),
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Eligibility, scores, percentiles over the scored universe, flags and explanations."""
    missing = [c for c in ("security_id", "sector_id") if c not in features.columns]
    if missing:
        raise ValueError(f"features lack required columns: {missing}")
    eligible = with_eligibility(features, strategy.eligibility).where("eligible")
    scored = score_rows(eligible, strategy, keys, materialize, detail=True)
    return explained(eligible.join(scored.drop(*MEASURES), list(keys)))


def rounded_percent(x: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(x * 100.0, 0).cast("int")


def explanation() -> Column:
    """Short reasons for a scored row. The texts and their thresholds."""
    pct = F.col("composite_percentile")
    top = F.greatest(F.lit(1), rounded_percent(1.0 - pct))
    bottom = F.greatest(F.lit(1), rounded_percent(pct))
    lines = [
        F.when(pct >= 0.5, F.format_string("Top %d%% del universo elegible", top)).when(
            pct < 0.5, F.format_string("Bottom %d%% del universo elegible", bottom)
        )
    ]
    for family in FAMILIES:
        p, label = F.col(f"{family}_percentile"), FAMILY_LABELS[family]
        shown = rounded_percent(p)
        lines.append(
            F.when(p.isNull(), F.lit(f"Sin datos suficientes de {label}"))
            .when(p >= 0.80, F.format_string(f"Fuerte en {label} (percentil %d%%)", shown))
            .when(p <= 0.20, F.format_string(f"Débil en {label} (percentil %d%%)", shown))
        )
    lines.append(
        F.when(
            F.col("risk_flag") == 1, F.lit("Volatilidad realizada en el 5% más alto del universo")
        )
    )
    return F.array_compact(F.array(*lines))


# Percentiles whose gate is open to everybody when nobody has the factor.
GATED = ("profitability", "momentum", "revisions")


def known_counts(scored: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Per date, how many rows have each gated percentile (one row per date)."""
    return scored.groupBy(date).agg(
        *[F.count(f"{f}_percentile").alias(f"_known_{f}") for f in GATED]
    )


def label_signals(scored: DataFrame, t: Thresholds, date: str = "as_of_date", known: DataFrame | None = None) -> DataFrame:
    """``decision`` per row; first matching rule wins. A null percentile counts as 0. ``known`` is
    :func:`known_counts` of the same rows, where it is there already."""
    # One row per decision date, bounded by the trading calendar.
    counts = known_counts(scored, date) if known is None else known
    with_counts = scored.join(F.broadcast(counts), date, "left")
    zero = F.lit(0.0)
    composite = F.coalesce("composite_percentile", zero)
    least = {
        "profitability": t.long_min_profitability_percentile,
        "momentum": t.long_min_momentum_percentile,
        "revisions": t.long_min_revisions_percentile,
    }
    gates = F.lit(True)
    for family in GATED:
        passed = F.coalesce(f"{family}_percentile", zero) >= least[family]
        gates = gates & ((F.col(f"_known_{family}") == 0) | passed)
    flagged = F.col("risk_flag") == 1
    buy = (
        (composite >= t.long_composite_percentile)
        & gates
        & (F.coalesce("liquidity_percentile", zero) >= t.long_min_liquidity_percentile)
        & ~flagged
    )
    weak_revisions = F.coalesce(
        F.col("revisions_percentile") <= t.reduce_revisions_percentile, F.lit(False)
    )
    decision = (
        F.when(buy & (composite >= t.strong_long_composite_percentile), "STRONG_LONG")
        .when(buy, "LONG")
        .when((composite <= t.avoid_composite_percentile) | flagged, "AVOID")
        .when((composite <= t.reduce_composite_percentile) | weak_revisions, "REDUCE")
        .when(composite >= t.watch_composite_percentile, "WATCH")
        .otherwise("NEUTRAL")
    )
    return with_counts.withColumn("decision", decision).drop(*[f"_known_{f}" for f in GATED])


def generate_signals(features: DataFrame, strategy: Strategy) -> DataFrame:
    """Screen, score, label: one row per scored security and date."""
    return label_signals(score_universe(features, strategy), strategy.signals)


def ranked_order() -> list[Column]:
    """Best score first, security id as the tie-break."""
    return [F.desc("composite_score"), F.asc("security_id")]
