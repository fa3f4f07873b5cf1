"""Risk limits as constraints on chosen weights: concentration, risk budget, exposure.

A portfolio is one packed row: its names (as many as :func:`select_holdings` allows), their groups
and weights, and their centred look-back returns, whose length the look-back bounds. The covariance
stays in factored form. A task advances all portfolios of a batch together: they are padded to one
array, each pass of capping moves every portfolio that still has something to place, and the nested
loops (passes, alternating caps, trims) are masks over the batch. One job, whatever the number of
portfolios and rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.config import RiskLimits
from quantloom.operators.risk import MIN_HISTORY, Z_95

BATCH = 64
CAPS_APPLIED, TRIMMED, SCALED = "INDUSTRY_SECTOR_CAPS_APPLIED", "RISK_CONTRIBUTION_TRIMMED", "EXPOSURE_SCALED_TO_"
CAP_TURNS, TRIMS, PASSES = 10, 50, 1000
TOLERANCE = 1e-10
#: Annual variance of a name nothing is known about.
UNKNOWN_VARIANCE = 0.30**2


def packed_portfolios(weights: DataFrame, returns: DataFrame, benchmark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, names (array of id, sector, industry, weight and look-back), benchmark (array of date, return)."""
    keys = list(keys)
    series = returns.groupBy(*keys, "security_id").agg(F.collect_list(F.struct("date", "ret")).alias("series"))
    index = benchmark.groupBy(*keys).agg(F.collect_list(F.struct("date", F.col("benchmark_return").alias("ret"))).alias("benchmark"))
    group = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    names = (
        weights.where("weight > 0").join(series, [*keys, "security_id"], "left")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("security_id", group("sector_id"), group("industry_id"), "weight", "series"))).alias("names"))
    )
    return names.join(index, keys, "left")


class Books:
    """Portfolios of a batch as padded arrays (portfolio x name, portfolio x day x name)."""

    def __init__(self, names: list[list[dict]], benchmarks: list[list[dict] | None], periods: int, min_coverage: float):
        self.periods = periods
        n, width = len(names), max(map(len, names))
        days = [sorted({s["date"] for x in book for s in x["series"] or ()}) for book in names]
        depth = max(map(len, days), default=0)
        self.weights = np.zeros((n, width))
        known = np.full((n, depth, width), np.nan)
        self.index = np.full((n, depth), np.nan)
        for b, book in enumerate(names):
            at = {day: i for i, day in enumerate(days[b])}
            self.weights[b, : len(book)] = [x["weight"] for x in book]
            for p, x in enumerate(book):
                for s in x["series"] or ():
                    known[b, at[s["date"]], p] = np.nan if s["ret"] is None else s["ret"]
            for s in benchmarks[b] or ():
                if s["date"] in at and s["ret"] is not None:
                    self.index[b, at[s["date"]]] = s["ret"]
        self.held, self.size = self.weights > 0, (self.weights > 0).sum(1)
        self.budget = self.weights.sum(1)
        self.groups = [one_hot([[x[g] for x in book] for book in names], width) for g in ("sector_id", "industry_id")]
        self.length = np.array([len(d) for d in days])
        self.returns = np.nan_to_num(known)
        self.shrink_covariance(~np.isnan(known), min_coverage)

    def shrink_covariance(self, known: np.ndarray, min_coverage: float) -> None:
        """Ledoit-Wolf towards a scaled identity from the date x date products of the centred returns;
        names with too little history get the median variance and no covariance."""
        length = np.maximum(self.length, 1)[:, None]
        self.good = self.held & (known.sum(1) >= min_coverage * length) & (self.length > 1)[:, None]
        inside = (np.arange(known.shape[1]) < self.length[:, None])[:, :, None] & self.good[:, None]
        self.centred = np.where(inside, self.returns - self.returns.sum(1, keepdims=True) / length[:, None], 0.0)
        gram = np.einsum("bkp,blp->bkl", self.centred, self.centred)
        n, p = self.length.astype(float), self.good.sum(1).astype(float)
        with np.errstate(all="ignore"):
            diagonal = np.einsum("bkk->bk", gram)
            mean = diagonal.sum(1) / n / p
            square = (gram**2).sum((1, 2)) / n**2
            spread = (square - p * mean**2) / p
            noise = ((diagonal**2).sum(1) - n * square) / (n * n * p)
            part = np.where(spread > 0, np.minimum(noise, spread) / spread, 0.0)
            variances = (self.centred**2).sum(1) / n[:, None]
        some = p > 0
        self.shrink, self.level = np.where(some, part, 0.0), np.where(some, mean, 0.0)
        shrunk = self.shrink[:, None] * self.level[:, None] + (1 - self.shrink)[:, None] * variances
        self.fallback = np.array([
            np.median(v[g]) if g.any() else UNKNOWN_VARIANCE / self.periods for v, g in zip(shrunk, self.good, strict=True)
        ])

    def sigma(self, w: np.ndarray) -> np.ndarray:
        """Annual covariance of each name with the portfolio."""
        own = np.where(self.good, w, 0.0)
        daily = np.einsum("bkp,bp->bk", self.centred, own)
        sampled = np.einsum("bkp,bk->bp", self.centred, daily) / np.maximum(self.length, 1)[:, None]
        shrunk = self.shrink[:, None] * self.level[:, None] * own + (1 - self.shrink)[:, None] * sampled
        return self.periods * np.where(self.good, shrunk, self.fallback[:, None] * w)

    def shares(self, w: np.ndarray) -> np.ndarray:
        """Each name's share of the portfolio's variance."""
        parts = w * self.sigma(w)
        total = parts.sum(1, keepdims=True)
        return np.where(total > 0, parts / np.where(total > 0, total, 1.0), 0.0)

    def capped(self, w: np.ndarray, which: int, position: float, group: float, going: np.ndarray) -> np.ndarray:
        """Name and group caps for the portfolios of ``going``, the rest as they are; sums keep the budget
        where the caps leave room for it."""
        member, going, out = self.groups[which], going.copy(), w.copy()
        base = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        state = base.copy()
        touched = going.copy()
        for _ in range(PASSES):
            x = np.minimum(state[going], position)
            m = member[going]
            held = np.einsum("bp,bpg->bg", x, m)
            factor = np.where(held > group, group / np.maximum(held, 1e-300), 1.0)
            x = x * np.einsum("bpg,bg->bp", m, factor)
            free = np.einsum("bpg,bg->bp", m, (group - held * factor > TOLERANCE).astype(float)) > 0
            receivers = np.where(free & (position - x > TOLERANCE), base[going], 0.0)
            gap, room = 1.0 - x.sum(1), receivers.sum(1)
            more = (gap > TOLERANCE) & (room > 0)
            state[going] = x + np.where(more, gap / np.where(room > 0, room, 1.0), 0.0)[:, None] * receivers
            going[np.flatnonzero(going)[~more]] = False
            if not going.any():
                break
        out[touched] = np.maximum(state[touched], 0.0) * self.budget[touched, None]
        return out

    def both_caps(self, w, position, sector, industry, going):
        return self.capped(self.capped(w, 0, position, sector, going), 1, position, industry, going)

    def over_group(self, w: np.ndarray, caps: tuple[float, float]) -> np.ndarray:
        sums = [np.einsum("bp,bpg->bg", w, g).max(1) for g in self.groups]
        return np.logical_or(*(s > self.budget * cap + 1e-9 for s, cap in zip(sums, caps, strict=True)))

    def betas(self, w: np.ndarray) -> np.ndarray:
        history = np.einsum("bkp,bp->bk", self.returns, w)
        out = np.full(len(w), np.nan)
        for b, (mine, market) in enumerate(zip(history, self.index, strict=True)):
            both = ~np.isnan(market)
            if both.sum() > MIN_HISTORY and market[both].var() > 0:
                out[b] = np.cov(mine[both], market[both])[0, 1] / market[both].var(ddof=1)
        return out


def one_hot(groups: list[list[str]], width: int) -> np.ndarray:
    places = [{g: i for i, g in enumerate(sorted(set(book)))} for book in groups]
    out = np.zeros((len(groups), width, max(map(len, places))))
    for b, book in enumerate(groups):
        out[b, range(len(book)), [places[b][g] for g in book]] = 1.0
    return out


def constrained(books: Books, limits: RiskLimits, position: float, sector: float) -> tuple[np.ndarray, list[list[str]]]:
    """Final weights and what was done to each portfolio."""
    start, industry = books.weights, limits.max_industry_weight
    actions: list[list[str]] = [[] for _ in start]
    w, going = start, np.ones(len(start), bool)
    for _ in range(CAP_TURNS):
        w = books.both_caps(w, position, sector, industry, going)
        going &= books.over_group(w, (sector, industry))
        if not going.any():
            break
    for b in np.flatnonzero(np.abs(w - start).sum(1) > 1e-6):
        actions[b].append(CAPS_APPLIED)
    cap = limits.max_single_name_risk_contribution
    # A budget that even equal shares exceed cannot be met; without returns there is nothing to trim.
    going, trimmed = (books.size * cap >= 1.0) & (books.length > 0), np.zeros(len(w), bool)
    for _ in range(TRIMS):
        share = books.shares(w)
        over = share > cap + 1e-6
        going &= over.any(1)
        if not going.any():
            break
        trimmed |= going
        cut = np.where(over & going[:, None], np.sqrt(cap / np.where(over, share, 1.0)), 1.0)
        w = books.both_caps(w * cut, position, sector, industry, going)
    for b in np.flatnonzero(trimmed):
        actions[b].append(TRIMMED)
    volatility = np.sqrt(np.maximum((w * books.sigma(w)).sum(1), 0.0))
    measures = (
        (volatility, limits.max_portfolio_volatility),
        (Z_95 * volatility / np.sqrt(books.periods), limits.max_var_95_daily),
        (books.betas(w), limits.max_beta),
    )
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.min([np.where(x > limit, limit / x, 1.0) for x, limit in measures], axis=0)
    scale = np.where(books.length > 0, np.maximum(scale, np.minimum(limits.min_gross_exposure / np.maximum(books.budget, 1e-12), 1.0)), 1.0)
    w = w * scale[:, None]
    for b in np.flatnonzero(scale < 1.0 - 1e-9):
        actions[b].append(f"{SCALED}{w[b].sum():.0%}")
    return w, actions


def enforced_limits(
    weights: DataFrame, returns: DataFrame, benchmark: DataFrame, keys: Sequence[str], limits: RiskLimits,
    max_position: float, max_sector: float, periods: int = 252, min_coverage: float = 0.6,
) -> DataFrame:
    """keys, names (array of security_id, before, weight), actions (array of text), one row a portfolio.

    ``weights``: keys, security_id, sector_id, industry_id, weight of chosen holdings. ``returns``:
    keys, security_id, date, ret over the look-back; ``benchmark``: keys, date, benchmark_return.
    First the position, sector and industry caps hold; then names above their share of the variance
    are trimmed by the root of the excess; then the whole is scaled towards cash where volatility,
    value at risk or beta exceed their limits, never below the minimum exposure. A portfolio without
    returns is only capped; weights that are null or not positive take no part.
    """
    keys = list(keys)
    packed = packed_portfolios(weights, returns, benchmark, keys)
    ids = dict(weights.dtypes)["security_id"]
    kinds = dict(weights.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema += f", names array<struct<security_id:{ids},before:double,weight:double>>, actions array<string>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                names = part.column("names").to_pylist()
                books = Books(names, part.column("benchmark").to_pylist(), periods, min_coverage)
                w, actions = constrained(books, limits, max_position, max_sector)
                out = [
                    [{"security_id": x["security_id"], "before": x["weight"], "weight": float(v)} for x, v in zip(book, row, strict=False)]
                    for book, row in zip(names, w, strict=True)
                ]
                id_type = part.schema.field("names").type.value_type.field("security_id").type
                kind = pa.list_(pa.struct([("security_id", id_type), ("before", pa.float64()), ("weight", pa.float64())]))
                columns = [part.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(out, kind), pa.array(actions, pa.list_(pa.string()))], names=[*keys, "names", "actions"]
                )

    return packed.mapInArrow(solve, schema)


def enforced_weights(enforced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, security_id, weight of what :func:`enforced_limits` returns; what it brings to nothing goes."""
    rows = enforced.select(*keys, F.explode("names").alias("name"))
    return rows.select(*keys, "name.security_id", "name.before", "name.weight").where("weight > 1e-12")
