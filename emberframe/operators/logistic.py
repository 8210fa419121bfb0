"""Binomial logistic regression by stratum, several formulas per pass."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .design import Expansion, Term
from .ols import _factor
from .solve import Fit, estimable
from .sums import packed, strata_of, sum_blocks, unpacked


def variance_distance(a, b):
    """Squared length of the variance curve t(1-t) between a and b."""

    def arc(t):
        u = 1.0 - 2.0 * np.asarray(t, dtype=float)
        return -(u * np.sqrt(1.0 + u * u) + np.arcsinh(u)) / 4.0

    return (arc(b) - arc(a)) ** 2


def fit_logistic(
    df: DataFrame,
    response: str,
    formulas: Mapping[str, Sequence[Term]],
    stratum: str | None = None,
    only: Mapping[str, Sequence[str]] | None = None,
    max_passes: int = 60,
    tolerance: float = 1e-10,
) -> list[Fit]:
    """Newton steps shared by all formulas and strata: one pass serves them all.

    ``only`` limits the formulas fitted in a stratum.
    """
    expansion = Expansion(formulas.values())
    factor = _factor(list(formulas.values()))
    keys = [k for k in (stratum, factor) if k]
    width = len(expansion.drivers)
    if only is None:
        only = {s: list(formulas) for s in strata_of(df, stratum)}
    runs = {
        (s, label): {
            "beta": np.zeros(len(formulas[label])),
            "step": np.zeros(len(formulas[label])),
            "deviance": math.inf,
            "passes": 0,
            "result": None,
        }
        for s, labels in sorted(only.items())
        for label in labels
    }
    for _ in range(max_passes):
        active = {k: r for k, r in runs.items() if r["result"] is None}
        if not active:
            break
        plan: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
        for (s, label), r in active.items():
            plan.setdefault(s, {})[label] = expansion.level_coefficients(formulas[label], r["beta"])

        def block(key, columns, plan=plan):
            wanted = plan.get(key[0] if stratum else "")
            if not wanted:
                return
            x, y = expansion.matrix(columns), columns[width]
            high = bool(factor) and float(key[-1]) == 1.0
            for label, levels in wanted.items():
                eta = levels[high] @ x
                mu = 1.0 / (1.0 + np.exp(-eta))
                deviance = 2.0 * np.logaddexp(0.0, np.where(y > 0.5, -eta, eta)).sum()
                tail = [len(y), y.sum(), deviance, variance_distance(y, mu).sum()]
                yield label, np.concatenate([packed((x * (mu * (1.0 - mu))) @ x.T), x @ (y - mu), tail])

        sums = sum_blocks(df, keys, [*expansion.drivers, response], block)
        for (s, label), r in active.items():
            _advance(r, sums, s, label, formulas[label], expansion, bool(stratum), bool(factor), tolerance, response)
    return [r["result"] or _result(r, s, label, formulas[label], False) for (s, label), r in runs.items()]


def _advance(r, sums, s, label, terms, expansion, by_stratum, by_factor, tolerance, response) -> None:
    size = len(expansion.bases)
    tri = size * (size + 1) // 2
    cross, score = np.zeros((2, size, size)), np.zeros((2, size))
    tail = np.zeros(4)
    for (key, name), vector in sums.items():
        if name != label or (by_stratum and key[0] != s):
            continue
        level = int(float(key[-1])) if by_factor else 0
        cross[level] += unpacked(vector[:tri], size)
        score[level] += vector[tri : tri + size]
        tail += vector[tri + size :]
    r["passes"] += 1
    deviance = tail[2]
    if deviance > r["deviance"] * (1 + 1e-12) + 1e-9:  # overshoot: go back half way
        r["step"] = r["step"] / 2
        r["beta"] = r["beta"] - r["step"]
        return
    information = expansion.assemble(cross[0], cross[1], terms)
    gradient = expansion.assemble_vector(score[0], score[1], terms)
    if "kept" not in r:
        r["kept"] = estimable(information)
    kept = r["kept"]
    inverse = np.linalg.inv(information[np.ix_(kept, kept)])
    change = abs(r["deviance"] - deviance) / (abs(deviance) + 0.1)
    r.update(deviance=deviance, inverse=inverse, tail=tail, gradient=gradient[kept])
    if change < tolerance:
        r["result"] = _result(r, s, label, terms, True)
        return
    step = np.zeros(len(terms))
    step[kept] = inverse @ gradient[kept]
    r["step"] = step
    r["beta"] = r["beta"] + step


def _result(r, s, label, terms, converged: bool) -> Fit:
    kept = r["kept"]
    n, ones, deviance, distance = r["tail"]
    mean = ones / n
    null_distance = float(ones * variance_distance(1.0, mean) + (n - ones) * variance_distance(0.0, mean))
    null_deviance = 0.0
    if 0 < mean < 1:
        null_deviance = -2.0 * (ones * math.log(mean) + (n - ones) * math.log(1 - mean))
    names = [t.name for t in terms]
    return Fit(
        label,
        s,
        "logistic",
        [names[i] for i in kept],
        r["beta"][kept],
        r["inverse"],
        int(round(n)),
        1.0,
        -deviance / 2,
        len(kept),
        statistic="z",
        aliased=[x for i, x in enumerate(names) if i not in set(kept)],
        extra={
            "deviance": float(deviance),
            "null_deviance": null_deviance,
            "r2_variance": 1 - distance / null_distance if null_distance > 0 else math.nan,
            "largest_score": float(np.abs(r["gradient"]).max()),
        },
        converged=converged,
        passes=r["passes"],
    )
