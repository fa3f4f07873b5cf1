"""Strategy parameters. Every number that can change a decision is a field here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Factor families and the direction of each of their features
# (True = higher is better).
FAMILY_FEATURES: dict[str, dict[str, bool]] = {
    "value": {"earnings_yield": True, "fcf_yield": True, "ev_ebitda": False},
    "growth": {"revenue_growth": True, "eps_growth": True},
    "profitability": {
        "roic": True,
        "gross_margin": True,
        "fcf_margin": True,
        "net_debt_ebitda": False,
    },
    "momentum": {"mom_12_1": True, "mom_6m": True, "mom_3m": True},
    "revisions": {"eps_rev_30d": True, "eps_rev_90d": True, "revisions_up_ratio": True},
}
FAMILIES = tuple(FAMILY_FEATURES)
FEATURES: dict[str, bool] = {
    name: up for members in FAMILY_FEATURES.values() for name, up in members.items()
}

# Research-only candidates, (name, higher is better, family).
RESEARCH_EXTRAS = (
    ("sales_yield", True, "value"),
    ("asset_growth", False, "investment"),
    ("gross_profitability", True, "quality"),
    ("accruals", False, "quality"),
    ("gross_margin_volatility", False, "quality"),
    ("earnings_volatility", False, "quality"),
    ("high_52w_ratio", True, "momentum"),
    ("ret_1m", False, "reversal"),
    ("volatility_63d", False, "low_risk"),
    ("volatility_252d", False, "low_risk"),
    ("beta_252d", False, "low_risk"),
    ("log_market_cap", False, "size"),
    ("net_issuance_1y", False, "issuance"),
)


@dataclass(frozen=True)
class Normalization:
    lower_quantile: float = 0.01
    upper_quantile: float = 0.99
    min_group_size: int = 5
    min_family_coverage: float = 0.5
    min_composite_coverage: float = 0.7


@dataclass(frozen=True)
class Eligibility:
    minimum_stock_price_usd: float = 5.0
    min_market_cap_usd: float = 2_000_000_000
    min_adv_usd: float = 5_000_000
    max_volatility_percentile: float = 0.95


@dataclass(frozen=True)
class Thresholds:
    strong_long_composite_percentile: float = 0.95
    long_composite_percentile: float = 0.85
    long_min_profitability_percentile: float = 0.60
    long_min_momentum_percentile: float = 0.50
    long_min_revisions_percentile: float = 0.50
    long_min_liquidity_percentile: float = 0.60
    watch_composite_percentile: float = 0.70
    reduce_composite_percentile: float = 0.55
    reduce_revisions_percentile: float = 0.30
    avoid_composite_percentile: float = 0.20


@dataclass(frozen=True)
class Sizing:
    weighting: str = "inverse_volatility"
    max_position_weight: float = 0.08
    max_sector_weight: float = 0.25
    min_holdings: int = 20
    max_holdings: int = 35
    max_turnover_per_rebalance: float = 0.25
    trade_band: float = 0.005
    rebalance_frequency: str = "monthly"

    def __post_init__(self) -> None:
        if self.weighting not in ("equal_weight", "inverse_volatility"):
            raise ValueError(f"unknown weighting: {self.weighting}")
        if self.min_holdings > self.max_holdings:
            raise ValueError("min_holdings must not exceed max_holdings")


@dataclass(frozen=True)
class RiskLimits:
    enforce: bool = False
    lookback_days: int = 252
    max_industry_weight: float = 0.15
    max_single_name_risk_contribution: float = 0.10
    max_portfolio_volatility: float = 0.25
    max_var_95_daily: float = 0.03
    max_beta: float = 1.30
    min_gross_exposure: float = 0.80


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 1.0
    half_spread_bps: float = 2.0
    slippage_bps: float = 5.0

    @property
    def total_bps(self) -> float:
        return self.commission_bps + self.half_spread_bps + self.slippage_bps


def default_weights() -> dict[str, float]:
    # Composite weight of each family.
    return {
        "value": 0.25,
        "growth": 0.15,
        "profitability": 0.25,
        "momentum": 0.20,
        "revisions": 0.15,
    }


@dataclass(frozen=True)
class Strategy:
    strategy_version: str = "v0.1.0"
    composite_weights: dict[str, float] = field(default_factory=default_weights)
    normalization: Normalization = Normalization()
    eligibility: Eligibility = Eligibility()
    signals: Thresholds = Thresholds()
    portfolio: Sizing = Sizing()
    costs: Costs = Costs()
    risk: RiskLimits = RiskLimits()

    def __post_init__(self) -> None:
        w = self.composite_weights
        if set(w) != set(FAMILIES):
            raise ValueError(f"composite_weights must name exactly {FAMILIES}")
        if min(w.values()) < 0 or abs(sum(w.values()) - 1.0) > 1e-9:
            raise ValueError("composite_weights must be non-negative and sum to 1")


@dataclass(frozen=True)
class Bars:
    """Bar counts behind the price features; ``DAILY`` and ``MONTHLY`` are the usual two."""

    month: int = 21
    year: int = 252
    adv: int = 20
    volatility: int = 63
    periods_per_year: int = 252
    min_beta_rows: int = 20


DAILY = Bars()
MONTHLY = Bars(month=1, year=12, adv=3, volatility=6, periods_per_year=12, min_beta_rows=6)


def override(base, path: str, value):
    """``base`` with one dotted field replaced; unknown names are an error."""
    head, _, rest = path.partition(".")
    if head not in {f.name for f in fields(base)}:
        raise KeyError(f"unknown config field: {path}")
    if rest:
        inner = getattr(base, head)
        if not is_dataclass(inner):
            raise KeyError(f"unknown config field: {path}")
        value = override(inner, rest, value)
    return replace(base, **{head: value})


def apply_overrides(base: Strategy, changes: Mapping[str, object], version: str | None = None):
    out = base
    for path, value in changes.items():
        out = override(out, path, value)
    return replace(out, strategy_version=version) if version else out


def configuration_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of a parameter grid as a table: config_id, one column a parameter.

    The number of a configuration has a digit for each parameter (the first one the highest), and
    each column looks its value up by its digit.
    """
    total = prod(len(values) for values in grid.values())
    columns, below = [], total
    for name, values in grid.items():
        below //= len(values)
        digit = (F.col("id") / below).cast("long") % len(values)
        columns.append(F.get(F.array(*map(F.lit, values)), digit.cast("int")).alias(name))
    return spark.range(total).select(F.col("id").alias("config_id"), *columns)


def scoring_fields(strategy: Strategy) -> dict[str, object]:
    """The settings that change scores; configurations equal here share one scored table."""
    return {
        "eligibility": asdict(strategy.eligibility),
        "normalization": asdict(strategy.normalization),
        "composite_weights": dict(strategy.composite_weights),
    }
