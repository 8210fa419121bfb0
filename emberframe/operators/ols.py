"""Ordinary least squares by stratum, and backward selection by AIC."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .design import CONSTANT, Base, Expansion, Term
from .solve import Fit, ols_from_cross
from .sums import packed, sum_blocks, unpacked


class CrossProducts:
    """Cross products per stratum, good for any submodel of the formulas."""

    def __init__(
        self, expansion: Expansion, low: dict[str, np.ndarray], high: dict[str, np.ndarray], formulas: Sequence[Sequence[Term]]
    ):
        self.expansion, self.low, self.high, self.formulas = expansion, low, high, formulas

    @property
    def strata(self) -> list[str]:
        return sorted(set(self.low) | set(self.high))

    def of(self, stratum: str, terms: Sequence[Term]) -> np.ndarray:
        none = np.zeros((len(self.expansion.bases) + 1,) * 2)
        return self.expansion.assemble(self.low.get(stratum, none), self.high.get(stratum, none), terms)

    def without(self, removed: DataFrame, response: str, stratum: str | None = None) -> CrossProducts:
        """Cross products of all rows but the removed ones, which alone are read.

        What remains must be a real share of the rows: sums lose as many digits
        as the removed rows outweigh the others.
        """
        gone = cross_products(removed, response, self.formulas, stratum)
        less = lambda a, b: {s: m - b[s] if s in b else m for s, m in a.items()}
        return CrossProducts(self.expansion, less(self.low, gone.low), less(self.high, gone.high), self.formulas)

    def correlations(self, stratum: str, drivers: Sequence[str]) -> np.ndarray:
        """Correlation matrix of the drivers over the stratum's rows."""
        terms = [Term(CONSTANT, False, None), *(Term(Base(d, 1), False, None) for d in drivers)]
        cross = self.of(stratum, terms)[:-1, :-1]
        centred = cross[1:, 1:] - np.outer(cross[0, 1:], cross[0, 1:]) / cross[0, 0]
        scale = np.sqrt(np.clip(np.diag(centred), 0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred / np.outer(scale, scale)


def cross_products(
    df: DataFrame, response: str, formulas: Sequence[Sequence[Term]], stratum: str | None = None
) -> CrossProducts:
    """One pass over the data for all formulas and all strata."""
    expansion = Expansion(formulas)
    factor = _factor(formulas)
    keys = ([stratum] if stratum else []) + ([factor] if factor else [])
    width = len(expansion.drivers)

    def block(key, columns):
        z = np.vstack([expansion.matrix(columns), columns[width]])
        yield "", packed(z @ z.T)

    sums = sum_blocks(df, keys, [*expansion.drivers, response], block)
    size = len(expansion.bases) + 1
    low: dict[str, np.ndarray] = {}
    high: dict[str, np.ndarray] = {}
    for (key, _), vector in sums.items():
        name = key[0] if stratum else ""
        level = float(key[-1]) if factor else 0.0
        (high if level == 1.0 else low)[name] = unpacked(vector, size)
    return CrossProducts(expansion, low, high, list(formulas))


def _factor(formulas: Sequence[Sequence[Term]]) -> str | None:
    named = {t.factor for terms in formulas for t in terms if t.factor}
    if len(named) > 1:
        raise ValueError(f"one factor per batch of formulas, got {sorted(named)}")
    return named.pop() if named else None


def fit_ols(
    df: DataFrame, response: str, formulas: Mapping[str, Sequence[Term]], stratum: str | None = None
) -> list[Fit]:
    """Every formula in every stratum, from one pass."""
    moments = cross_products(df, response, list(formulas.values()), stratum)
    return [ols_of(moments, s, terms, label) for s in moments.strata for label, terms in formulas.items()]


def ols_of(moments: CrossProducts, stratum: str, terms: Sequence[Term], label: str = "ols") -> Fit:
    cross = moments.of(stratum, terms)
    n = int(round(cross[0, 0]))
    return ols_from_cross(cross, [t.name for t in terms], n, label, stratum)


def droppable(terms: Sequence[Term]) -> list[Term]:
    """Terms whose removal keeps every interaction's main effects."""
    used = {t.base for t in terms if t.by_factor and t.base.power}
    out = []
    for t in terms:
        if t.base.power == 0:
            if t.by_factor and not used:
                out.append(t)
        elif t.by_factor or t.base not in used:
            out.append(t)
    return out


def step_backward(
    moments: CrossProducts, stratum: str, terms: Sequence[Term], label: str = "step"
) -> tuple[Fit, list[tuple[str, float]]]:
    """Drop one term at a time while the AIC falls; no further pass over the data.

    Returns the final fit and the path of (dropped term, AIC after it).
    """
    current = tuple(terms)
    fit = ols_of(moments, stratum, current, label)
    path: list[tuple[str, float]] = [("", _step_aic(fit.n, fit.extra["rss"], len(fit.names)))]
    while True:
        # leaving out one term raises the residual sum of squares by beta^2 / (X'X)^-1
        rise = dict(zip(fit.names, fit.beta**2 / np.diag(fit.covariance) * fit.sigma2))
        trials = [
            (_step_aic(fit.n, fit.extra["rss"] + rise[t.name], len(fit.names) - 1), t.name)
            for t in droppable(current)
            if t.name in rise
        ]
        if not trials or min(trials)[0] >= path[-1][1]:
            return fit, path
        path.append(min(trials)[::-1])
        current = tuple(t for t in current if t.name != path[-1][0])
        fit = ols_of(moments, stratum, current, label)


def collinear(moments: CrossProducts, drivers: Sequence[str], above: float = 0.7) -> list[tuple[str, str, str, float]]:
    """(stratum, a, b, r): pairs of drivers whose signed correlation exceeds the threshold, from sums at hand."""
    out = []
    for s in moments.strata:
        r = moments.correlations(s, drivers)
        pairs = [(i, j) for i in range(len(drivers)) for j in range(i + 1, len(drivers)) if r[i, j] > above]
        out += [(s, drivers[i], drivers[j], float(r[i, j])) for i, j in pairs]
    return out


def _step_aic(n: int, rss: float, size: int) -> float:
    return n * math.log(rss / n) + 2 * size
