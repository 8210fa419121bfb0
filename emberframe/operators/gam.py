"""Additive models: a factor dummy plus one smooth per driver.

Each smooth is a natural cubic regression spline through ten quantile knots,
and the amounts of smoothing minimise generalised cross-validation. The model
class is that of a default thin-plate smooth with ten basis functions; the
basis differs, so numbers agree only approximately.

The data is read once, for the cross products of all basis columns. A fit is a
piecewise cubic of each driver, so it predicts with column expressions alone;
beyond the outermost knots it goes on as a straight line.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import f_upper, t_two_sided
from .ranks import quantiles
from .sums import key_text, packed, sum_blocks, unpacked

KNOTS = 10
LOG_LAMBDA = (-16.0, 20.0)


class Spline:
    """Natural cubic spline with its values at the knots as coefficients."""

    def __init__(self, knots: Sequence[float]):
        self.knots = np.unique(np.asarray(knots, dtype=float))
        k = len(self.knots)
        if k < 3:
            raise ValueError("a smooth needs at least 3 distinct knots")
        h = np.diff(self.knots)
        second = np.zeros((k - 2, k))
        band = np.zeros((k - 2, k - 2))
        for i in range(k - 2):
            second[i, i : i + 3] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
            band[i, i] = (h[i] + h[i + 1]) / 3
            if i + 1 < k - 2:
                band[i, i + 1] = band[i + 1, i] = h[i + 1] / 6
        inner = np.linalg.solve(band, second)
        self.curvature = np.vstack([np.zeros(k), inner, np.zeros(k)])
        self.penalty = second.T @ inner

    def basis(self, x: np.ndarray) -> np.ndarray:
        inside = np.clip(x, self.knots[0], self.knots[-1])
        j = np.clip(np.searchsorted(self.knots, inside, side="right") - 1, 0, len(self.knots) - 2)
        left, right = self.knots[j], self.knots[j + 1]
        h = right - left
        to_right, to_left = right - inside, inside - left
        out = (to_right**3 / h - h * to_right)[:, None] / 6 * self.curvature[j]
        out += (to_left**3 / h - h * to_left)[:, None] / 6 * self.curvature[j + 1]
        rows = np.arange(len(x))
        out[rows, j] += to_right / h
        out[rows, j + 1] += to_left / h
        beyond = np.flatnonzero(x != inside)
        if len(beyond):
            ends = self.end_slopes()
            out[beyond] += (x - inside)[beyond, None] * ends[(x[beyond] > inside[beyond]).astype(int)]
        return out

    def end_slopes(self) -> np.ndarray:
        """Slopes at the first and the last knot, as combinations of the values at the knots."""
        h = np.diff(self.knots)
        ends = np.zeros((2, len(self.knots)))
        ends[0, :2] = [-1 / h[0], 1 / h[0]]
        ends[1, -2:] = [-1 / h[-1], 1 / h[-1]]
        ends[0] -= h[0] / 6 * self.curvature[1]
        ends[1] += h[-1] / 6 * self.curvature[-2]
        return ends

    def place(self, x: Column) -> Column:
        """Where a value lies, as an array of one: its interval, the distances to both ends, and how far it is beyond the knots.

        Each step is a ``transform`` of an array of one, which binds what the next
        step uses several times; nested expressions would be spelled out each time.
        """
        k = [float(v) for v in self.knots]
        inside = F.least(F.greatest(x, F.lit(k[0])), F.lit(k[-1]))
        first = F.transform(F.array(F.struct(x.alias("x"), inside.alias("inside"))), lambda p: F.struct(
            p["x"].alias("x"), p["inside"].alias("inside"), sum(((p["inside"] >= v).cast("int") for v in k[1:-1]), F.lit(0)).alias("j")
        ))
        left, right = (F.array(*map(F.lit, c)) for c in (k[:-1], k[1:]))
        return F.transform(first, lambda p: F.struct(
            p["j"].alias("j"), (F.get(right, p["j"]) - p["inside"]).alias("to_right"), (p["inside"] - F.get(left, p["j"])).alias("to_left"),
            (p["x"] - p["inside"]).alias("beyond"),
        ))

    def curve(self, p: Column, at_knots: Sequence[float]) -> Column:
        """The curve through these values at the knots, at a place."""
        values = np.asarray(at_knots, dtype=float)
        slopes = [float(v) for v in self.end_slopes() @ values]
        second, values = (F.array(*[F.lit(float(v)) for v in c]) for c in (self.curvature @ values / 6, values))
        r, t, h = p["to_right"], p["to_left"], p["to_right"] + p["to_left"]
        cubic = (r * r * r / h - h * r) * F.get(second, p["j"]) + (t * t * t / h - h * t) * F.get(second, p["j"] + 1)
        line = (r * F.get(values, p["j"]) + t * F.get(values, p["j"] + 1)) / h
        return cubic + line + p["beyond"] * F.when(p["beyond"] < 0, slopes[0]).otherwise(slopes[1])

    def column(self, x: Column, at_knots: Sequence[float]) -> Column:
        """The curve through these values at the knots, as an expression; null where x is."""
        return F.when(x.isNotNull(), F.get(F.transform(self.place(x), lambda p: self.curve(p, at_knots)), F.lit(0)))


@dataclass
class GamFit:
    """Parametric and smooth tables plus the spline coefficients."""

    stratum: str
    n: int
    sigma2: float
    gcv: float
    edf: float
    r2: float
    parametric: list[dict]
    smooths: list[dict]
    coefficients: list[dict]
    splines: dict[str, Spline]
    penalties: dict[str, float]  # weight of each smooth's integrated squared curvature
    covariance: np.ndarray  # of the coefficients, in their order
    factor: str | None = None
    converged: bool = True

    def estimates(self) -> dict[str, float]:
        return {c["term"]: c["estimate"] for c in self.coefficients}

    def at_knots(self, driver: str) -> list[float]:
        by_term = self.estimates()
        return [by_term[f"s({driver}).{i + 1}"] for i in range(len(self.splines[driver].knots))]

    def fitted(self) -> Column:
        """Prediction for a row of this fit's stratum; null where a driver is."""
        by_term = self.estimates()
        out = F.lit(by_term["(Intercept)"])
        if self.factor:
            out = out + F.col(self.factor).cast("double") * F.lit(by_term[self.factor])
        for driver, spline in self.splines.items():
            x = F.col(driver).cast("double")
            out = out + spline.column(x, self.at_knots(driver))
        return out


def predict_gam(df: DataFrame, fits: Sequence[GamFit], stratum: str | None = None, name: str = "fitted") -> DataFrame:
    """Adds the prediction of the row's stratum; null in a stratum without a fit."""
    if not stratum:
        return df.withColumn(name, fits[0].fitted())
    out = F.lit(None).cast("double")
    for f in fits:
        out = F.when(key_text(stratum) == f.stratum, f.fitted()).otherwise(out)
    return df.withColumn(name, out)


def spline_columns(df: DataFrame, splines: Mapping[str, Spline], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., one column ``s(driver).i`` per knot): the basis of every smooth at each row."""
    def basis(driver: str, spline: Spline) -> Column:
        x = F.col(driver).cast("double")
        units = np.eye(len(spline.knots))
        curves = F.transform(spline.place(x), lambda p: F.array(*[spline.curve(p, unit) for unit in units]))
        return F.when(x.isNotNull(), F.get(curves, F.lit(0)))

    every = {d: basis(d, spline) for d, spline in splines.items()}
    placed = df.select(*keep, *[c.alias(f"_at_{d}") for d, c in every.items()])
    columns = [F.get(f"_at_{d}", F.lit(i)).alias(f"s({d}).{i + 1}") for d, s in splines.items() for i in range(len(s.knots))]
    return placed.select(*keep, *columns)


def fit_gam(
    df: DataFrame,
    response: str,
    smooths: Mapping[str, Sequence[str]] | Sequence[str],
    stratum: str | None = None,
    factor: str | None = "No_IDL",
    knots: int = KNOTS,
    log_lambda: float | None = None,
    penalty: float | None = None,
) -> list[GamFit]:
    """One additive model per stratum.

    ``smooths`` may differ by stratum. Instead of choosing the smoothing, fix it
    for every term: by ``log_lambda``, relative to the term's cross products, or by
    ``penalty``, the weight of the integrated squared curvature itself.
    """
    if log_lambda is not None and penalty is not None:
        raise ValueError("give log_lambda or penalty, not both")
    per_stratum = smooths if isinstance(smooths, Mapping) else None
    drivers = sorted({d for ds in smooths.values() for d in ds}) if per_stratum else list(smooths)
    splines = _splines(df, drivers, stratum, knots, per_stratum)
    keys = [stratum] if stratum else []
    values = [*drivers, *([factor] if factor else []), response]

    def block(key, columns):
        mine = splines.get(key[0] if stratum else "")
        if not mine:
            return
        parts = [np.ones((columns.shape[1], 1))]
        if factor:
            parts.append(columns[len(drivers)][:, None])
        parts += [s.basis(columns[drivers.index(d)]) for d, s in mine.items()]
        parts.append(columns[-1][:, None])
        z = np.hstack(parts)
        yield "", packed(z.T @ z)

    fits = []
    for (key, _), vector in sorted(sum_blocks(df, keys, values, block).items()):
        name = key[0] if stratum else ""
        size = int((math.isqrt(8 * len(vector) + 1) - 1) // 2)
        fits.append(_solve(unpacked(vector, size), splines[name], name, factor, log_lambda, penalty))
    return fits


def _splines(df, drivers, stratum, knots, per_stratum) -> dict[str, dict[str, Spline]]:
    levels = {f"k{i}": i / (knots - 1) for i in range(knots)}
    table = quantiles(df, [stratum] if stratum else [], drivers, levels)
    table = (table.withColumn(stratum, key_text(stratum)) if stratum else table).collect()
    out: dict[str, dict[str, Spline]] = {}
    for row in sorted(table, key=lambda r: drivers.index(r["variable"])):
        name = row[stratum] if stratum else ""
        if per_stratum is not None and row["variable"] not in per_stratum.get(name, ()):
            continue
        out.setdefault(name, {})[row["variable"]] = Spline(_spaced([row[k] for k in levels]))
    return out


def _spaced(knots: Sequence[float]) -> list[float]:
    """Tied quantiles, as of a driver that is mostly zero, give way to knots in the widest gaps."""
    spaced = sorted(set(knots))
    while 1 < len(spaced) < len(knots):
        gaps = np.diff(spaced)
        at = int(np.argmax(gaps))
        spaced.insert(at + 1, spaced[at] + gaps[at] / 2)
    return spaced


def _solve(cross: np.ndarray, splines: dict[str, Spline], stratum: str, factor: str | None, log_lambda, penalty) -> GamFit:
    fixed = 2 if factor else 1
    n = int(round(cross[0, 0]))
    # each smooth sums to zero over the data, so the intercept stays identified
    turns, places, at, new_at = [np.eye(fixed)], [], fixed, fixed
    for s in splines.values():
        k = len(s.knots)
        q, _ = np.linalg.qr(cross[0, at : at + k][:, None], mode="complete")
        turns.append(q[:, 1:])
        places.append((at, k, slice(new_at, new_at + k - 1)))
        at, new_at = at + k, new_at + k - 1
    turn = np.zeros((at, new_at))
    row = col = 0
    for t in turns:
        turn[row : row + t.shape[0], col : col + t.shape[1]] = t
        row, col = row + t.shape[0], col + t.shape[1]
    a = turn.T @ cross[:at, :at] @ turn
    b = turn.T @ cross[:at, at]
    yy = cross[at, at]
    penalties, scales = [], []
    for s, (start, k, where) in zip(splines.values(), places):
        t = turn[start : start + k, where]
        p = t.T @ s.penalty @ t
        full = np.zeros_like(a)
        scales.append(1.0 if penalty is not None else np.trace(a[where, where]) / np.trace(p))
        full[where, where] = p * scales[-1]
        penalties.append(full)

    def at_rho(rho):
        m = a + sum(math.exp(r) * p for r, p in zip(rho, penalties))
        inverse = np.linalg.inv((m + m.T) / 2)
        beta = inverse @ b
        edf = float(np.sum(inverse * a.T))
        rss = yy - 2 * beta @ b + beta @ a @ beta
        return n * rss / (n - edf) ** 2, inverse, beta, edf, rss

    settled = True
    if penalty is not None:
        rho = np.full(len(penalties), math.log(penalty))
    elif log_lambda is not None:
        rho = np.full(len(penalties), log_lambda)
    else:
        rho, settled = _choose(lambda r: at_rho(r)[0], np.zeros(len(penalties)))
    gcv, inverse, beta, edf, rss = at_rho(rho)
    sigma2 = rss / (n - edf)
    influence = inverse @ a
    own = np.diag(influence)
    reference = 2 * own - np.sum(influence * influence.T, axis=1)
    bayes = inverse * sigma2
    tss = yy - cross[0, at] ** 2 / n

    parametric = []
    for i, name in enumerate(["(Intercept)", factor][:fixed]):
        se = math.sqrt(bayes[i, i])
        parametric.append(
            {"term": name, "estimate": float(beta[i]), "std_error": se, "statistic": float(beta[i]) / se,
             "p_value": t_two_sided(float(beta[i]) / se, n - edf)}
        )
    tables, coefficients = [], [{"term": r["term"], "estimate": r["estimate"]} for r in parametric]
    for (driver, s), (start, k, where) in zip(splines.items(), places):
        e, r = float(own[where].sum()), float(reference[where].sum())
        rank = max(1, min(k - 1, int(round(r))))
        values, vectors = np.linalg.eigh(bayes[where, where])
        top = np.argsort(values)[::-1][:rank]
        f = float((((vectors[:, top].T @ beta[where]) ** 2) / values[top]).sum()) / rank
        tables.append({"term": f"s({driver})", "edf": e, "ref_df": r, "f": f, "p_value": f_upper(f, rank, n - edf),
                       "log_lambda": float(rho[len(tables)])})
        at_knots = turn[start : start + k, where] @ beta[where]
        coefficients += [{"term": f"s({driver}).{i + 1}", "estimate": float(v)} for i, v in enumerate(at_knots)]
    weights = {d: math.exp(r) * c for d, r, c in zip(splines, rho.tolist(), scales)}
    return GamFit(
        stratum, n, sigma2, gcv, edf, 1 - rss / tss, parametric, tables, coefficients, splines, weights,
        turn @ bayes @ turn.T, factor, settled,
    )


def _choose(score, rho: np.ndarray) -> tuple[np.ndarray, bool]:
    """Minimise the score over one log-lambda at a time; whether it settled."""
    ratio = (math.sqrt(5) - 1) / 2
    best = score(rho)
    for sweep in range(30):
        before = best
        for i in range(len(rho)):
            def f(v):
                trial = rho.copy()
                trial[i] = v
                return score(trial)

            grid = np.linspace(*LOG_LAMBDA, 12) if sweep == 0 else np.array([rho[i] - 3, rho[i], rho[i] + 3])
            grid = np.clip(grid, *LOG_LAMBDA)
            heights = [f(v) for v in grid]
            low = int(np.argmin(heights))
            lo, hi = grid[max(low - 1, 0)], grid[min(low + 1, len(grid) - 1)]
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            fa, fb = f(a), f(b)
            while hi - lo > 1e-2:
                if fa < fb:
                    hi, b, fb = b, a, fa
                    a = hi - ratio * (hi - lo)
                    fa = f(a)
                else:
                    lo, a, fa = a, b, fb
                    b = lo + ratio * (hi - lo)
                    fb = f(b)
            found = min([((fa, a)), (fb, b), (heights[low], grid[low])])
            if found[0] < best:
                best, rho[i] = found[0], found[1]
        if before - best <= 1e-10 * abs(before):
            return rho, True
    return rho, False
