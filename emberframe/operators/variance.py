"""Weighted least squares and random intercepts with a variance function.

The residual variance is sigma^2 * exp(2 * sum(delta_j * v_j)); optionally each
group has a random intercept. All parameters are found by Newton steps on the
profiled likelihood. One step takes one pass over the data, shared by every
candidate and every stratum: besides the weighted cross products the pass
returns those with weights times v_j and v_j * v_k, which give the second-order
expansion of the cross products in delta, hence exact derivatives.

The same sums evaluate a model at given parameters, in one pass and without a
search. Group effects are predicted from the sums of each group, so they cost no
further pass either.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .design import Expansion, Term
from .ols import _factor
from .solve import Fit, estimable
from .sums import packed, strata_of, sum_blocks, unpacked

STEP_LIMIT = 0.5
LOG_WEIGHT_LIMIT = 600.0  # a trial that gives any row more is rejected, and its step halved
DELTA_LIMIT = 10.0
LOG_RATIO = (-23.0, 23.0)


@dataclass(frozen=True)
class VarianceModel:
    """A formula with its variance covariates; empty covariates mean equal variances."""

    terms: tuple[Term, ...]
    covariates: tuple[str, ...] = ()
    reml: bool = True


@dataclass(frozen=True)
class Given:
    """Parameters to evaluate a model at: delta of each covariate, and tau^2 / sigma^2 of the random intercept."""

    delta: tuple[float, ...] = ()
    ratio: float = 0.0


@dataclass
class _Search:
    model: VarianceModel
    label: str
    stratum: str
    delta: np.ndarray
    step: np.ndarray
    best: float = -math.inf
    best_delta: np.ndarray | None = None
    state: dict = field(default_factory=dict)
    done: bool = False
    converged: bool = False
    passes: int = 0


def fit_variance_models(
    df: DataFrame,
    response: str,
    models: Mapping[str, VarianceModel],
    stratum: str | None = None,
    group: str | None = None,
    only: Mapping[str, Sequence[str]] | None = None,
    max_passes: int = 30,
    tolerance: float = 1e-7,
) -> list[Fit]:
    """Fit every model in every stratum.

    With ``group`` each model has a random intercept per group. ``only`` limits
    the models tried in a stratum; strata it does not name are left out.
    """
    expansion, factor, covariates = _columns(models)
    searches = _searches(df, models, stratum, only)
    keys = [k for k in (stratum, group, factor) if k]
    for _ in range(max_passes):
        active = [s for s in searches if not s.done]
        if not active:
            break
        sums = _weighted_pass(df, response, expansion, covariates, keys, bool(stratum), active)
        for s in active:
            _advance(s, _assembled(sums, s, expansion, bool(stratum), bool(group), bool(factor)), bool(group), tolerance)
    return [_finish(s, group) for s in searches]


def evaluate_variance_models(
    df: DataFrame,
    response: str,
    models: Mapping[str, VarianceModel],
    at: Mapping[str | tuple[str, str], Given],
    stratum: str | None = None,
    group: str | None = None,
    only: Mapping[str, Sequence[str]] | None = None,
) -> list[Fit]:
    """Every model in every stratum at given variance parameters: one pass, no search.

    ``at`` names them by label, or by (stratum, label) where strata differ. The
    fixed effects, sigma and the likelihood are the best ones given these.
    """
    expansion, factor, covariates = _columns(models)
    searches = _searches(df, models, stratum, only)
    for s in searches:
        given = at.get((s.stratum, s.label), at.get(s.label))
        if given is None or len(given.delta) != len(s.model.covariates):
            raise ValueError(f"{s.label}: give one delta for each of {s.model.covariates} (stratum {s.stratum!r})")
        if given.ratio and not group:
            raise ValueError(f"{s.label}: a variance ratio needs a group")
        s.delta = np.array(given.delta, dtype=float)
        s.state["tau"] = given.ratio
    # the spread of the fixed part is that of unweighted rows
    plain = [_Search(VarianceModel(s.model.terms), s.label, s.stratum, np.zeros(0), np.zeros(0)) for s in searches]
    keys = [k for k in (stratum, group, factor) if k]
    sums = _weighted_pass(df, response, expansion, covariates, keys, bool(stratum), searches + plain, derivatives=False)
    for s, p in zip(searches, plain):
        flat = _assembled(sums, p, expansion, bool(stratum), bool(group), bool(factor))
        _measure(s, flat[1][:, 0].sum(axis=0), flat[2][:, 0].sum())
        groups, cross, tails = _assembled(sums, s, expansion, bool(stratum), bool(group), bool(factor))
        surface = _Surface(cross, tails, s.state["kept"], s.model.reml)
        s.best, s.best_delta, s.passes = surface.loglik(np.zeros(surface.k), s.state["tau"]), s.delta, 1
        s.state.update(surface=surface, groups=groups)
        s.done = s.converged = True
    return [_finish(s, group) for s in searches]


def _columns(models: Mapping[str, VarianceModel]) -> tuple[Expansion, str | None, list[str]]:
    formulas = [m.terms for m in models.values()]
    return Expansion(formulas), _factor(formulas), sorted({c for m in models.values() for c in m.covariates})


def _searches(df, models, stratum, only) -> list[_Search]:
    if only is None:
        only = {s: list(models) for s in strata_of(df, stratum)}
    return [
        _Search(models[label], label, s, np.zeros(len(models[label].covariates)), np.zeros(len(models[label].covariates)))
        for s, labels in sorted(only.items())
        for label in labels
    ]


def _weighted_pass(df, response, expansion, covariates, keys, by_stratum, active, derivatives=True):
    """Weighted cross products of every active candidate, in one job.

    Candidates of a stratum that stand at the same delta share their sums.
    """
    width, k_all = len(expansion.drivers), len(covariates)
    plan: dict[str, dict[str, tuple[list[int], np.ndarray]]] = {}
    for s in active:
        at = [covariates.index(c) for c in s.model.covariates]
        s.state["ticket"] = _ticket(s)
        plan.setdefault(s.stratum, {})[s.state["ticket"]] = (at, s.delta.copy())

    def block(key, columns):
        wanted = plan.get(key[0] if by_stratum else "")
        if not wanted:
            return
        z = np.vstack([expansion.matrix(columns), columns[width + k_all]])
        for ticket, (at, delta) in wanted.items():
            v = columns[[width + i for i in at]]
            log_w = -2.0 * (delta @ v) if at else np.zeros(z.shape[1])
            w = np.exp(np.clip(log_w, -LOG_WEIGHT_LIMIT, LOG_WEIGHT_LIMIT))
            total = log_w.sum() if np.abs(log_w).max() <= LOG_WEIGHT_LIMIT else -math.inf
            tail = np.concatenate([[z.shape[1], total], v.sum(axis=1)])
            yield f"{ticket}|", np.concatenate([packed((z * w) @ z.T), tail])
            for j in range(len(at) if derivatives else 0):
                zj = z * (w * v[j])
                yield f"{ticket}|{j}", packed(zj @ z.T)
                for l in range(j, len(at)):
                    yield f"{ticket}|{j},{l}", packed((zj * v[l]) @ z.T)

    values = [*expansion.drivers, *covariates, response]
    return sum_blocks(df, keys, values, block)


def _ticket(s: _Search) -> str:
    return ";".join(f"{c}={d!r}" for c, d in zip(s.model.covariates, s.delta.tolist()))


def _assembled(sums, s: _Search, expansion: Expansion, by_stratum: bool, by_group: bool, by_factor: bool):
    """Per group: cross products of the terms, their first and second expansions, and the tails."""
    size = len(expansion.bases) + 1
    tri = size * (size + 1) // 2
    k = len(s.model.covariates)
    parts = [""] + [str(j) for j in range(k)] + [f"{j},{l}" for j in range(k) for l in range(j, k)]
    groups = sorted({key[1 if by_stratum else 0] for key, _ in sums if not by_stratum or key[0] == s.stratum}) if by_group else [""]
    low = np.zeros((len(groups), len(parts), size, size))
    high = np.zeros_like(low)
    tails = np.zeros((len(groups), 2 + k))
    for g, name in enumerate(groups):
        for level in (0, 1):
            for i, part in enumerate(parts):
                for text in (_level_texts(level) if by_factor else [None] if level == 0 else []):
                    key = tuple(x for x in ((s.stratum if by_stratum else None), (name if by_group else None), text) if x is not None)
                    vector = sums.get((key or ("",), f"{s.state['ticket']}|{part}"))
                    if vector is None:
                        continue
                    (high if level else low)[g, i] += unpacked(vector[:tri], size)
                    if part == "":
                        tails[g] += vector[tri:]
    return groups, expansion.assemble(low, high, s.model.terms), tails


def _level_texts(level: int) -> list[str]:
    return [f"{level}.0", str(level)]


class _Surface:
    """The profiled log-likelihood as a function of a shift in delta and of log tau.

    tau is the random-intercept variance over sigma^2.
    """

    def __init__(self, cross: np.ndarray, tails: np.ndarray, kept: np.ndarray, reml: bool):
        pick = np.append(kept, cross.shape[-1] - 1)
        self.cross = cross[:, :, pick[:, None], pick[None, :]]
        self.k = tails.shape[1] - 2
        self.n = tails[:, 0].sum()
        self.log_w = tails[:, 1].sum()
        self.v_sum = tails[:, 2:].sum(axis=0)
        self.p = len(kept)
        self.reml = reml

    def shifted(self, h: np.ndarray) -> np.ndarray:
        if self.k == 0 or not h.any():
            return self.cross[:, 0]
        weights = [1.0] + [-2.0 * x for x in h]
        for j in range(self.k):
            for l in range(j, self.k):
                weights.append((2.0 if j == l else 4.0) * h[j] * h[l])
        return np.einsum("i,gipq->gpq", np.array(weights), self.cross)

    def combined(self, h: np.ndarray, tau: float) -> tuple[np.ndarray, float]:
        a = self.shifted(h)
        total = a.sum(axis=0)
        if tau == 0.0:
            return total, 0.0
        s = a[:, 0, 0]
        first = a[:, 0, :]
        c = tau / (1.0 + tau * s)
        return total - (first * c[:, None]).T @ first, float(np.log1p(tau * s).sum())

    def loglik(self, h: np.ndarray, tau: float) -> float:
        matrix, log_v = self.combined(h, tau)
        if not np.isfinite(matrix).all():
            return -math.inf
        try:
            root = np.linalg.cholesky(matrix)
        except np.linalg.LinAlgError:
            return -math.inf
        rss = root[-1, -1] ** 2
        dof = self.n - self.p if self.reml else self.n
        out = -dof / 2 * (math.log(2 * math.pi * rss / dof) + 1)
        out += (self.log_w - 2.0 * float(h @ self.v_sum)) / 2 - log_v / 2
        if self.reml:
            out -= float(np.log(np.diag(root)[:-1]).sum())
        return out

    def group_effects(self, beta: np.ndarray, tau: float) -> np.ndarray:
        """Best linear unbiased prediction of each group's intercept, from its weighted sums."""
        a = self.cross[:, 0]
        residual = a[:, 0, -1] - a[:, 0, :-1] @ beta
        return tau * residual / (1.0 + tau * a[:, 0, 0])

    def best_log_tau(self) -> float:
        """Grid, then golden section; minus infinity when no group variance is best."""
        h = np.zeros(self.k)
        f = lambda t: self.loglik(h, math.exp(t))
        grid = np.linspace(*LOG_RATIO, 24)
        heights = [f(t) for t in grid]
        top = int(np.argmax(heights))
        lo, hi = grid[max(top - 1, 0)], grid[min(top + 1, len(grid) - 1)]
        ratio = (math.sqrt(5) - 1) / 2
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        fa, fb = f(a), f(b)
        while hi - lo > 1e-9:
            if fa > fb:
                hi, b, fb = b, a, fa
                a = hi - ratio * (hi - lo)
                fa = f(a)
            else:
                lo, a, fa = a, b, fb
                b = lo + ratio * (hi - lo)
                fb = f(b)
        t = (lo + hi) / 2
        return t if f(t) > self.loglik(h, 0.0) + 1e-10 else -math.inf

    def newton_step(self, log_tau: float) -> np.ndarray:
        """Step in delta (with log tau free when it is inside its range)."""
        free = math.isfinite(log_tau) and LOG_RATIO[0] + 1e-3 < log_tau < LOG_RATIO[1] - 1e-3
        m = self.k + free

        def f(x: np.ndarray) -> float:
            tau = math.exp(log_tau + (x[-1] if free else 0.0)) if math.isfinite(log_tau) else 0.0
            return self.loglik(x[: self.k], tau)

        eps = 1e-4
        zero = np.zeros(m)
        centre = f(zero)
        unit = np.eye(m) * eps
        plus = [f(u) for u in unit]
        minus = [f(-u) for u in unit]
        gradient = np.array([(a - b) / (2 * eps) for a, b in zip(plus, minus)])
        hessian = np.zeros((m, m))
        for i in range(m):
            hessian[i, i] = (plus[i] - 2 * centre + minus[i]) / eps**2
            for j in range(i):
                both = f(unit[i] + unit[j]) - f(unit[i] - unit[j]) - f(unit[j] - unit[i]) + f(-unit[i] - unit[j])
                hessian[i, j] = hessian[j, i] = both / (4 * eps**2)
        values, vectors = np.linalg.eigh(hessian)
        curve = np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max()))
        step = vectors @ ((vectors.T @ gradient) / curve)
        step = step[: self.k]
        size = np.abs(step).max() if len(step) else 0.0
        return step * min(1.0, STEP_LIMIT / size) if size > 0 else step


def _measure(s: _Search, total: np.ndarray, n: float) -> None:
    """What the unweighted cross products tell: the estimable terms and the spread of each."""
    p = len(s.model.terms)
    s.state["kept"] = estimable(total[:p, :p])
    s.state["unweighted"] = total
    if n <= len(s.state["kept"]):
        raise ValueError(f"{s.label}: too few rows for its coefficients (stratum {s.stratum!r})")


def _advance(s: _Search, assembled, random: bool, tolerance: float) -> None:
    groups, cross, tails = assembled
    s.passes += 1
    if "kept" not in s.state:
        _measure(s, cross[:, 0].sum(axis=0), tails[:, 0].sum())  # the first pass has delta = 0
    surface = _Surface(cross, tails, s.state["kept"], s.model.reml)
    log_tau = surface.best_log_tau() if random else -math.inf
    tau = math.exp(log_tau) if math.isfinite(log_tau) else 0.0
    height = surface.loglik(np.zeros(surface.k), tau)
    if height >= s.best - 1e-9 * max(1.0, abs(s.best)):
        s.best, s.best_delta = height, s.delta.copy()
        s.state.update(surface=surface, tau=tau, groups=groups)
        if surface.k == 0:
            s.done = s.converged = True
            return
        step = surface.newton_step(log_tau)
        if np.abs(step).max() < tolerance:
            s.done = s.converged = True
            return
    else:
        step = s.step / 2
        if np.abs(step).max() < tolerance:
            s.done = s.converged = True
            return
    s.step = step
    s.delta = np.clip(s.best_delta + step, -DELTA_LIMIT, DELTA_LIMIT)
    if np.array_equal(s.delta, s.best_delta):
        s.done = True  # pinned at the bound: not converged


def _finish(s: _Search, group: str | None) -> Fit:
    random = bool(group)
    surface: _Surface = s.state["surface"]
    tau = s.state["tau"]
    kept = s.state["kept"]
    names = [t.name for t in s.model.terms]
    matrix, _ = surface.combined(np.zeros(surface.k), tau)
    p = len(kept)
    inverse = np.linalg.inv((matrix[:p, :p] + matrix[:p, :p].T) / 2)
    beta = inverse @ matrix[:p, p]
    n = int(round(surface.n))
    rss = matrix[p, p] - beta @ matrix[:p, p]
    sigma2 = rss / (n - p if s.model.reml else n)
    unweighted = s.state["unweighted"]
    spread = unweighted[np.ix_(kept, kept)]
    mean = spread[0] @ beta / n
    fixed = (beta @ spread @ beta - n * mean * mean) / (n - 1)
    between = tau * sigma2
    extra = {f"delta_{c}": float(d) for c, d in zip(s.model.covariates, s.best_delta)}
    extra["tau2"] = between
    extra["marginal_r2"] = fixed / (fixed + between + sigma2)
    extra["conditional_r2"] = (fixed + between) / (fixed + between + sigma2)
    m = len(s.state["groups"])
    return Fit(
        s.label,
        s.stratum,
        ("lme" if random else "gls") + ("_reml" if s.model.reml else "_ml"),
        [names[i] for i in kept],
        beta,
        inverse * sigma2,
        n,
        sigma2,
        s.best,
        p + 1 + len(s.model.covariates) + (1 if random else 0),
        df=n - m - (p - 1) if random else n - p,
        aliased=[x for i, x in enumerate(names) if i not in set(kept)],
        extra=extra,
        converged=s.converged,
        passes=s.passes,
        group=group,
        effects=dict(zip(s.state["groups"], map(float, surface.group_effects(beta, tau)))) if random else {},
    )
