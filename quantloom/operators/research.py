"""Factor research: forward returns, rank correlations, quintiles, significance, verdicts.

Cross-sections are grouped by ``(date, factor)`` and ranked with the distributed ranks; the
time series that follow hold one value per schedule date, so their windows are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ranking import (
    equal_count_bucket,
    first_rank,
    mid_rank,
    mid_rank_over,
    rank_values,
    with_ranks,
)
from quantloom.functions.scalars import ratio, two_sided_p
from quantloom.operators.calendar import schedule_index
from quantloom.operators.crosssection import dealt_percentiles

# Smallest cross-section, smallest sample for buckets, hurdles of the verdict.
MIN_CROSS_SECTION = 30
MIN_BUCKET_PAIRS = 50
MIN_DISTINCT = 5
MIN_MONTHS = 6
T_HURDLE = 3.0
HOLDOUT_T = 1.0
HORIZONS = (1, 3, 6)


# ---------------------------------------------------------------- forward returns
def return_legs(schedule: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``(as_of_date, horizon, entry_pos, exit_pos, exit_date)`` for every scheduled date whose
    exit exists. Fill is at the bar after the decision. Bounded by schedule x horizons."""
    placed = schedule_index(schedule).join(F.broadcast(calendar), "date")
    entries = placed.select(
        F.col("date").alias("as_of_date"), "k", (F.col("pos") + 1).alias("entry_pos")
    )
    exits = placed.select("k", (F.col("pos") + 1).alias("exit_pos"))
    steps = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    asked = entries.select("*", steps).withColumn("_exit_k", F.col("k") + F.col("horizon"))
    legs = asked.join(exits.withColumnRenamed("k", "_exit_k"), "_exit_k")
    dated = calendar.select(F.col("pos").alias("exit_pos"), F.col("date").alias("exit_date"))
    return legs.join(F.broadcast(dated), "exit_pos").select(
        "as_of_date", "horizon", "entry_pos", "exit_pos", "exit_date"
    )


def forward_returns(
    grid: DataFrame, legs: DataFrame, filled: bool = True, price: str = "open"
) -> DataFrame:
    """``(as_of_date, security_id, horizon, forward_return, exit_date)``.

    Entry needs a trade on the entry bar. With ``filled`` a name that stopped trading leaves
    at its last known price, otherwise a missing exit is null.
    """
    frame = Window.partitionBy("security_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    last = F.last(price, ignorenulls=True).over(frame) if filled else F.col(price)
    quotes = grid.select("security_id", "pos", F.col(price).alias("_raw"), last.alias("_exit"))
    # A handful of rows per scheduled date: bounded by the calendar.
    entries = quotes.join(
        F.broadcast(legs), quotes["pos"] == legs["entry_pos"]
    ).select("as_of_date", "security_id", "horizon", "exit_date", "exit_pos", "_raw")
    exits = quotes.select("security_id", F.col("pos").alias("exit_pos"), "_exit")
    return entries.join(exits, ["security_id", "exit_pos"], "left").select(
        "as_of_date",
        "security_id",
        "horizon",
        (ratio("_exit", "_raw") - 1.0).alias("forward_return"),
        "exit_date",
    )


# ---------------------------------------------------------------- cross-sectional statistics
def guarded_percentiles(
    pct: DataFrame, universe_size: DataFrame, date: str = "as_of_date"
) -> DataFrame:
    """Percentiles that can be studied: a large enough universe, enough values of the factor,
    and at least five distinct percentiles. Adds ``universe`` and ``factor_size``."""
    sizes = (
        pct.where("pct is not null")
        .groupBy(date, "factor", "pct")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(date, "factor")
        .agg(F.sum("_n").alias("factor_size"), F.count(F.lit(1)).alias("_distinct"))
        .where((F.col("factor_size") >= MIN_CROSS_SECTION) & (F.col("_distinct") >= MIN_DISTINCT))
        .drop("_distinct")
    )
    big = universe_size.where(F.col("universe") >= MIN_CROSS_SECTION)
    # One row per (date, factor) of a fixed candidate list.
    keep = sizes.join(big, date)
    return pct.join(F.broadcast(keep), [date, "factor"])


def spearman(
    df: DataFrame, groups: Sequence[str], a: str, b: str, minimum: int, out: str = "ic"
) -> DataFrame:
    """Rank correlation per group over rows where both are known; null below ``minimum``."""
    groups = list(groups)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left = with_ranks(pairs.select(*groups, a, b), groups, a).select(*groups, b, mid_rank().alias("_ra"))
    ranked = with_ranks(left, groups, b, counted=pairs).select(*groups, "_ra", mid_rank().alias("_rb"))
    return rank_correlation(ranked, groups, minimum, out)


def rank_correlation(ranked: DataFrame, groups: Sequence[str], minimum: int, out: str = "ic") -> DataFrame:
    """Correlation per group of the ranks ``_ra`` and ``_rb``; null below ``minimum`` or where one is constant."""
    counted = ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("_ra", "_rb").alias("_c"),
        F.min("_ra").alias("_amin"),
        F.max("_ra").alias("_amax"),
        F.min("_rb").alias("_bmin"),
        F.max("_rb").alias("_bmax"),
    )
    varies = (F.col("_amin") < F.col("_amax")) & (F.col("_bmin") < F.col("_bmax"))
    return counted.select(
        *groups, "n", F.when((F.col("n") >= minimum) & varies, F.col("_c")).alias(out)
    )


def bucketed(df: DataFrame, groups: Sequence[str], score: str, ret: str, minimum: int):
    """Rows with both values, in groups of at least ``minimum`` pairs, with a 0-4 bucket."""
    pairs = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    ranked = first_rank(pairs, groups, score, "security_id", "_rank").where(
        F.col("_rank_n") >= minimum
    )
    bucket = equal_count_bucket(F.col("_rank"), F.col("_rank_n"))
    return ranked.withColumn("bucket", bucket).drop("_rank", "_rank_n")


def quintile_returns(buckets: DataFrame, groups: Sequence[str], ret: str) -> DataFrame:
    """Mean return per bucket in excess of the mean over all buckets: ``q1`` to ``q5``."""
    groups = list(groups)
    inside = [F.avg(F.when(F.col("bucket") == q, F.col(ret))).alias(f"_q{q}") for q in range(5)]
    means = buckets.groupBy(*groups).agg(F.avg(ret).alias("_all"), *inside)
    return means.select(
        *groups, *[(F.col(f"_q{q}") - F.col("_all")).alias(f"q{q + 1}") for q in range(5)]
    )


def factor_study(
    universe: DataFrame,
    features: Mapping[str, bool],
    returns: DataFrame,
    universe_size: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    date: str = "as_of_date",
) -> DataFrame:
    """One row per date and factor that can be studied (see :func:`guarded_percentiles`): ``universe``,
    ``factor_size``, ``ic_<horizon>`` (see :func:`spearman`) and, for the first horizon, ``pairs``, ``q1`` to
    ``q5`` and ``top``, the names in the top bucket (null and empty below the least number of pairs).

    ``universe``: the rows with their features; ``universe_size``: the dates to study and their rows;
    ``returns``: as_of_date, security_id, horizon, forward_return. A row meets its returns before it is
    dealt, and its percentiles are ranked against them where they lie.
    """
    first = horizons[0]
    asked = returns.where(F.col("forward_return").isNotNull() & F.col("horizon").isin(*horizons))
    listed = asked.groupBy(date, "security_id").agg(
        *[F.collect_list(F.when(F.col("horizon") == h, F.col("forward_return"))).alias(f"_r{h}") for h in horizons]
    )
    # One row per date.
    dates = F.broadcast(universe_size.where(F.col("universe") >= MIN_CROSS_SECTION))
    present = {f: up for f, up in features.items() if f in universe.columns}
    rows = universe.select(date, "security_id", "sector_id", *present).join(dates.select(date), date, "left_semi")
    lists = [f"_r{h}" for h in horizons]
    met = rows.join(listed, [date, "security_id"], "left")
    pct = dealt_percentiles(met, present, [date, "security_id"], date, "sector_id", carry=lists)

    keys = [date, "_b", "_f"]
    group = Window.partitionBy(*keys)
    by_pct = group.orderBy("pct")
    sized = pct.withColumns({"factor_size": F.count("pct").over(group), "_distinct": F.dense_rank().over(by_pct)})
    kept = sized.withColumn("_distinct", F.max("_distinct").over(group)).where(
        (F.col("factor_size") >= MIN_CROSS_SECTION) & (F.col("_distinct") >= MIN_DISTINCT)
    )
    # A name has one return a horizon, or as many as its key is repeated.
    most = F.greatest(F.lit(1), *[F.size(c) for c in lists])
    paired = kept.select(*keys, "security_id", "factor_size", "pct", *lists, F.explode(F.sequence(F.lit(0), most - 1)).alias("_j"))
    paired = paired.withColumns({c: F.get(c, F.col("_j")) for c in lists}).drop("_j")
    up_to = by_pct.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = by_pct.rangeBetween(Window.currentRow, Window.currentRow)
    ranks = {f"_a{h}": F.count(f"_r{h}").over(up_to) - (F.count(f"_r{h}").over(tied) - 1) / F.lit(2.0) for h in horizons}
    ranks["pairs"] = F.count(f"_r{first}").over(group)
    for h in horizons:
        ranks[f"_b{h}"] = mid_rank_over([*keys, F.col(f"_r{h}").isNull()], f"_r{h}")
    own = Window.partitionBy(*keys, F.col(f"_r{first}").isNull())
    ranks["_place"] = F.row_number().over(own.orderBy("pct", "security_id"))
    ranked = paired.withColumns(ranks)
    in_buckets = F.col(f"_r{first}").isNotNull() & (F.col("pairs") >= MIN_BUCKET_PAIRS)
    bucket = F.when(in_buckets, equal_count_bucket(F.col("_place"), F.col("pairs")))
    placed = ranked.withColumns({"bucket": bucket, "_ret": F.when(in_buckets, F.col(f"_r{first}"))})

    sums = [F.max("factor_size").alias("factor_size"), F.max("pairs").alias("pairs"), F.avg("_ret").alias("_all")]
    sums += [F.avg(F.when(F.col("bucket") == q, F.col("_ret"))).alias(f"_q{q}") for q in range(5)]
    sums.append(F.collect_list(F.when(F.col("bucket") == 4, F.col("security_id"))).alias("top"))
    for h in horizons:
        known = F.col(f"_r{h}").isNotNull()
        a, b = F.when(known, F.col(f"_a{h}")), F.when(known, F.col(f"_b{h}"))
        varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        sums.append(F.when((F.count(f"_r{h}") >= MIN_CROSS_SECTION) & varies, F.corr(a, b)).alias(f"ic_{h}"))
    names = F.array(*map(F.lit, present))
    return placed.groupBy(*keys).agg(*sums).join(dates, date).select(
        date, F.get(names, F.col("_f")).alias("factor"), "universe", "factor_size", "pairs",
        *[f"ic_{h}" for h in horizons], *[(F.col(f"_q{q}") - F.col("_all")).alias(f"q{q + 1}") for q in range(5)], "top",
    )


def top_turnover(buckets: DataFrame, date: str = "as_of_date") -> DataFrame:
    """:func:`turnover_of` the top bucket of each factor."""
    return turnover_of(buckets.where("bucket = 4").select(date, "factor", "security_id"), buckets.select(date, "factor").distinct(), date)


def turnover_of(top: DataFrame, dates: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Share of the previous top bucket that left it, per factor.

    "Previous" is the last of ``dates``, those on which this factor had buckets at all.
    """
    order = Window.partitionBy("factor").orderBy(date)
    indexed = dates.withColumn("_i", F.row_number().over(order))
    top = top.join(F.broadcast(indexed), [date, "factor"]).select(
        date, "factor", "security_id", "_i"
    )
    before = top.select("factor", "security_id", (F.col("_i") + 1).alias("_i"), F.lit(1).alias("_was"))
    sizes = before.groupBy("factor", "_i").agg(F.count(F.lit(1)).alias("_before"))
    stayed = (
        top.join(before, ["factor", "security_id", "_i"], "left")
        .groupBy(date, "factor", "_i")
        .agg(F.count("_was").alias("_stayed"))
    )
    return stayed.join(sizes, ["factor", "_i"]).select(
        date, "factor", (1.0 - F.col("_stayed") / F.col("_before")).alias("turnover")
    )


def factor_correlations(
    wide: DataFrame, factors: Sequence[str], date: str = "as_of_date"
) -> DataFrame:
    """Pairwise-complete correlation of percentiles per date, one row per pair of factors.

    Each task keeps six moments per (date, pair) of the fixed factor list and emits them once;
    Spark adds them up. Nothing is emitted per pair *and* row.
    """
    names = list(factors)
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def moments(batches):
        import numpy as np
        import pandas as pd

        left = np.array([i for i, _ in upper])
        right = np.array([j for _, j in upper])
        kept: dict = {}

        def rows():
            for day, sums in kept.items():
                block = {"day": [day] * len(upper), "i": left, "j": right}
                for place, label in enumerate(("n", "sa", "sb", "sab", "saa", "sbb")):
                    block[label] = sums[place][left, right]
                yield pd.DataFrame(block)

        for frame in batches:
            for day, part in frame.groupby("day", sort=False):
                x = part[names].to_numpy(dtype=float)
                known = ~np.isnan(x)
                x, m = np.where(known, x, 0.0), known.astype(float)
                new = np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
                kept[day] = kept[day] + new if day in kept else new
            if len(kept) > 512:
                yield from rows()
                kept = {}
        yield from rows()

    schema = "day date, i int, j int, n double, sa double, sb double, sab double, saa double, sbb double"
    partial = wide.select(F.col(date).alias("day"), *names).mapInPandas(moments, schema)
    summed = partial.groupBy("day", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")]
    )
    var_a = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    var_b = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    # Percentiles lie in (0, 1): a variance sum below 1e-12 is a constant column.
    corr = F.when((F.col("n") > 1) & (var_a > 1e-12) & (var_b > 1e-12), cov / F.sqrt(var_a * var_b))
    labels = F.array(*[F.lit(f) for f in names])
    return summed.where("n > 0").select(
        F.col("day").alias(date),
        F.get(labels, F.col("i")).alias("factor_a"),
        F.get(labels, F.col("j")).alias("factor_b"),
        corr.alias("corr"),
    )


def mean_correlations(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("factor_a", "factor_b").agg(F.avg("corr").alias("corr"))


def pairs_above(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Redundant pairs, strongest first."""
    return correlations.where(
        (F.col("factor_a") != F.col("factor_b")) & (F.abs("corr") >= threshold)
    ).orderBy(F.abs("corr").desc(), "factor_a", "factor_b")


# ---------------------------------------------------------------- time-series statistics
def newey_west(
    df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int, out: str
) -> DataFrame:
    """t-statistic of the mean with a Bartlett-kernel variance, one row per key.

    The series of a key has one value per schedule date; autocovariances are sums of products
    with the lagged deviation, so no row leaves the engine.
    """
    keys = list(keys)
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    known = df.where(F.col(value).isNotNull()).withColumn(
        "_e", F.col(value) - F.avg(value).over(whole)
    )
    shifted = known.select(
        *keys,
        value,
        "_e",
        *[F.lag("_e", k).over(ordered).alias(f"_e{k}") for k in range(1, lags + 1)],
    )
    n = F.count(F.lit(1))
    variance = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lags + 1):
        weight = 2.0 * (1.0 - k / (lags + 1))
        covariance = F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0)) / n
        variance = variance + F.lit(weight) * covariance
    stats = shifted.groupBy(*keys).agg(
        n.alias("_n"), F.avg(value).alias("_mean"), variance.alias("_var")
    )
    t = F.when(
        (F.col("_n") >= 3) & (F.col("_var") > 0), F.col("_mean") / F.sqrt(F.col("_var") / F.col("_n"))
    )
    return stats.select(*keys, t.alias(out))


def benjamini_hochberg(df: DataFrame, p: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted q-values over the known p-values (a family of tests is a fixed short list)."""
    part = Window.partitionBy(*keys, F.col(p).isNull())
    order = part.orderBy(p)
    m = F.count(p).over(part)
    raw = F.col(p) * m / F.row_number().over(order)
    step = df.withColumn("_raw", F.when(F.col(p).isNotNull(), raw))
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.min("_raw").over(later), F.lit(1.0))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("_raw")


def mean_t(x: str) -> Column:
    """Plain t-statistic of a mean; null for one value or no spread."""
    spread = F.stddev_samp(x)
    return F.when(
        (F.count(x) > 1) & (spread > 0), F.avg(x) / spread * F.sqrt(F.count(x).cast("double"))
    )


def ic_summary(ic: DataFrame, keys: Sequence[str], value: str = "ic") -> DataFrame:
    known = ic.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.avg(value).alias("mean_ic"),
        mean_t(value).alias("t_stat"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("pct_positive"),
        F.count(F.lit(1)).alias("periods"),
    )


def spread_summary(spreads: DataFrame, value: str, periods_per_year: int, name: str) -> DataFrame:
    """Summary row of a top-minus-bottom spread, its mean annualised."""
    one = ic_summary(spreads.withColumn("factor", F.lit(name)), ["factor"], value)
    return one.withColumn("mean_ic", F.col("mean_ic") * periods_per_year)


def ic_by_year(ic: DataFrame, value: str = "ic") -> DataFrame:
    """Mean per factor and calendar year, for every year that occurs."""
    return ic.groupBy("factor", F.year("as_of_date").alias("year")).agg(F.avg(value).alias(value))


def monotonicity(means: Sequence[str]) -> Column:
    """Correlation of 0..4 with the average ranks of the five bucket means in a row."""
    ranks = []
    for m in means:
        below = sum([F.when(F.col(o) < F.col(m), 1.0).otherwise(0.0) for o in means], F.lit(0.0))
        same = sum([F.when(F.col(o) == F.col(m), 1.0).otherwise(0.0) for o in means], F.lit(0.0))
        ranks.append(below + (same + 1.0) / 2.0)
    # Ranks have mean 3 and the places 0..4 have mean 2 and squared deviation 10.
    cross = sum([(r - 3.0) * (i - 2.0) for i, r in enumerate(ranks)], F.lit(0.0))
    spread = sum([(r - 3.0) * (r - 3.0) for r in ranks], F.lit(0.0))
    known = F.lit(True)
    for m in means:
        known = known & F.col(m).isNotNull()
    return F.when(known & (spread > 0), cross / F.sqrt(spread * 10.0))


def significance(ic: DataFrame, horizon: int = HORIZONS[0]) -> DataFrame:
    """Months, Newey-West t, p- and q-value of each factor's ``horizon`` correlations: those columns of
    :func:`summarize_factors`, from these correlations alone."""
    series = ic.where(F.col("horizon") == horizon)
    months = series.groupBy("factor").agg(F.count("ic").alias("months")).where(F.col("months") >= MIN_MONTHS)
    t = newey_west(series, ["factor"], "as_of_date", "ic", max(horizon, 1), f"nw_t_{horizon}m")
    tested = months.join(t, "factor", "left").withColumn("p_value", two_sided_p(f"nw_t_{horizon}m"))
    return benjamini_hochberg(tested, "p_value", "q_value_bh")


def summarize_factors(
    ic: DataFrame,
    quintiles: DataFrame,
    turnover: DataFrame,
    coverage: DataFrame,
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """One row per factor with at least six months of one-period correlations.

    ``ic``: as_of_date, factor, horizon, ic. ``quintiles``: as_of_date, factor, q1..q5.
    ``turnover`` and ``coverage``: as_of_date, factor and the value.
    """
    first = horizons[0]
    one = ic.where((F.col("horizon") == first) & F.col("ic").isNotNull())
    order = Window.partitionBy("factor").orderBy("as_of_date")
    n = F.count(F.lit(1)).over(Window.partitionBy("factor"))
    halves = one.withColumn("_first", F.row_number().over(order) <= F.floor(n / 2))
    base = halves.groupBy("factor").agg(
        F.count(F.lit(1)).alias("months"),
        F.when(
            F.stddev_samp("ic") > 0, F.avg("ic") / F.stddev_samp("ic") * F.lit(12.0**0.5)
        ).alias("ic_ir"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(F.when(F.col("_first"), F.col("ic"))).alias("ic_first_half"),
        F.avg(F.when(~F.col("_first"), F.col("ic"))).alias("ic_second_half"),
    )
    out = base.where(F.col("months") >= MIN_MONTHS)
    means = ic.groupBy("factor").agg(
        *[
            F.avg(F.when(F.col("horizon") == h, F.col("ic"))).alias(f"mean_ic_{h}m")
            for h in horizons
        ]
    )
    out = out.join(means, "factor", "left")
    for h in horizons:
        series = ic.where(F.col("horizon") == h)
        out = out.join(
            newey_west(series, ["factor"], "as_of_date", "ic", max(h, 1), f"nw_t_{h}m"),
            "factor",
            "left",
        )
    spread = quintiles.withColumn("_spread", F.col("q5") - F.col("q1"))
    names = [f"q{i}" for i in range(1, 6)]
    by_factor = spread.groupBy("factor").agg(
        (F.avg("_spread") * 12).alias("q5_q1_annual"),
        (F.avg("q5") * 12).alias("top_excess_annual"),
        *[F.avg(q).alias(q) for q in names],
    )
    by_factor = by_factor.withColumn("monotonicity", monotonicity(names)).drop(*names)
    out = (
        out.join(by_factor, "factor", "left")
        .join(
            newey_west(spread, ["factor"], "as_of_date", "_spread", 1, "q5_q1_nw_t"),
            "factor",
            "left",
        )
        .join(
            turnover.groupBy("factor").agg(F.avg("turnover").alias("top_quintile_turnover")),
            "factor",
            "left",
        )
        .join(coverage.groupBy("factor").agg(F.avg("coverage").alias("coverage")), "factor", "left")
        .withColumn("p_value", two_sided_p(f"nw_t_{first}m"))
    )
    return benjamini_hochberg(out, "p_value", "q_value_bh")


def verdicts(research: DataFrame, holdout: DataFrame, candidates: DataFrame, fdr: float = 0.10):
    """Verdict per factor. A factor that predicts against its hypothesis is reported as
    inverted, never flipped."""
    held = holdout.select(
        "factor",
        F.col("mean_ic_1m").alias("holdout_mean_ic_1m"),
        F.col("nw_t_1m").alias("holdout_nw_t_1m"),
    )
    joined = research.join(held, "factor", "left").join(candidates, "factor", "left")
    significant = F.coalesce(F.col("q_value_bh") < fdr, F.lit(False))
    positive = F.coalesce(F.col("mean_ic_1m") > 0, F.lit(False))
    agrees = F.coalesce(
        (F.col("holdout_mean_ic_1m") > 0) & (F.col("holdout_nw_t_1m") >= HOLDOUT_T), F.lit(False)
    )
    verdict = (
        F.when(significant & positive & agrees, "ACCEPT")
        .when(significant & positive, "FAILS_HOLDOUT")
        .when(significant, "INVERTED")
        .otherwise("NOT_SIGNIFICANT")
    )
    order = F.array_position(
        F.array(*[F.lit(v) for v in ("ACCEPT", "FAILS_HOLDOUT", "INVERTED", "NOT_SIGNIFICANT")]),
        F.col("verdict"),
    )
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("passes_t3", F.coalesce(F.col("nw_t_1m") > T_HURDLE, F.lit(False)))
        .orderBy(order, F.desc_nulls_last("nw_t_1m"), "factor")
        .select(
            "factor",
            "family",
            "higher_is_better",
            "in_strategy",
            "mean_ic_1m",
            "nw_t_1m",
            "q_value_bh",
            "passes_t3",
            "holdout_mean_ic_1m",
            "holdout_nw_t_1m",
            "verdict",
        )
    )


def equal_weight_composite(pct: DataFrame, chosen: DataFrame | Sequence[str]) -> DataFrame:
    """Mean percentile of the chosen factors per row of the universe."""
    if isinstance(chosen, DataFrame):
        kept = pct.join(F.broadcast(chosen.select("factor").distinct()), "factor", "left_semi")
    else:
        kept = pct.where(F.col("factor").isin(list(chosen)))
    return kept.groupBy("as_of_date", "security_id").agg(F.avg("pct").alias("research_composite"))


def distinct_values(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact number of distinct values per group."""
    return rank_values(df, groups, value).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
