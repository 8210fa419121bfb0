"""Driver-side algebra on cross-product matrices of a few dozen columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..functions.tails import f_upper, normal_two_sided, t_two_sided

ALIAS_TOLERANCE = 1e-9


def estimable(cross: np.ndarray, tolerance: float = ALIAS_TOLERANCE) -> np.ndarray:
    """Indices of columns that are not combinations of earlier ones."""
    scale = np.sqrt(np.diag(cross))
    safe = np.where(scale > 0, scale, 1.0)
    unit = cross / np.outer(safe, safe)
    kept: list[int] = []
    rows: list[np.ndarray] = []
    for j in range(len(unit)):
        row = unit[j].copy()
        for r, k in zip(rows, kept):
            row -= r[j] * r
        if scale[j] > 0 and row[j] > tolerance:
            rows.append(row / math.sqrt(row[j]))
            kept.append(j)
    return np.array(kept, dtype=int)


@dataclass
class Fit:
    """Coefficients and quality of one fitted model."""

    label: str
    stratum: str
    kind: str
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    sigma2: float
    loglik: float
    parameters: int
    statistic: str = "t"
    df: float = math.nan
    aliased: list[str] = field(default_factory=list)
    extra: dict[str, float] = field(default_factory=dict)
    converged: bool = True
    passes: int = 1
    group: str | None = None
    effects: dict[str, float] = field(default_factory=dict)  # predicted intercept of each group

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))

    def coefficients(self) -> list[dict]:
        """One row per term: name, estimate, standard error, statistic, p."""
        rows = []
        for name, b, s in zip(self.names, self.beta, self.se):
            stat = b / s if s > 0 else math.nan
            p = t_two_sided(stat, self.df) if self.statistic == "t" else normal_two_sided(stat)
            rows.append({"term": name, "estimate": float(b), "std_error": float(s), "statistic": float(stat), "p_value": p})
        return rows


def ols_from_cross(cross: np.ndarray, names: list[str], n: int, label: str = "ols", stratum: str = "") -> Fit:
    """Least squares from the cross products of (terms, response)."""
    p_all = len(names)
    kept = estimable(cross[:p_all, :p_all])
    inverse = np.linalg.inv(_symmetric(cross[np.ix_(kept, kept)]))
    beta = inverse @ cross[kept, p_all]
    total = cross[p_all, p_all]
    rss = max(total - beta @ cross[kept, p_all], 0.0)
    p = len(kept)
    if n <= p:
        raise ValueError(f"{n} rows are too few for {p} coefficients (stratum {stratum!r})")
    mean = cross[0, p_all] / n
    tss = total - n * mean * mean
    sigma2 = rss / (n - p)
    loglik = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.inf
    r2 = 1 - rss / tss if tss > 0 else math.nan
    f = (tss - rss) / (p - 1) / sigma2 if p > 1 and sigma2 > 0 else math.nan
    return Fit(
        label, stratum, "ols", [names[i] for i in kept], beta, inverse * sigma2, n, sigma2, loglik, p + 1,
        df=n - p,
        aliased=[names[i] for i in range(p_all) if i not in set(kept)],
        extra={
            "rss": rss,
            "r2": r2,
            "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - p),
            "f": f,
            "f_df1": p - 1,
            "f_df2": n - p,
            "f_p_value": f_upper(f, p - 1, n - p),
        },
    )


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2
