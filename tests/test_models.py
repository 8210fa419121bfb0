"""Fits against dense NumPy solutions and planted parameters."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberframe.operators import diagnose as D
from emberframe.operators.design import model_matrix, model_terms
from emberframe.operators.gam import Spline, fit_gam
from emberframe.operators.logistic import fit_logistic, variance_distance
from emberframe.operators.ols import cross_products, droppable, fit_ols, ols_of, step_backward
from emberframe.operators.variance import VarianceModel, fit_variance_models
from emberframe.sources import report

TERMS = model_terms(["a", "b"], ["a", "b"], "d")


@pytest.fixture(scope="module")
def frame():
    """Two strata, six groups; variance grows with a, groups differ in level."""
    rng = np.random.default_rng(7)
    n = 4000
    a, b = rng.normal(size=n), rng.normal(size=n)
    d = (rng.random(n) < 0.4).astype(float)
    g = rng.integers(0, 6, n)
    s = rng.integers(0, 2, n)
    level = rng.normal(scale=0.8, size=(2, 6))
    noise = rng.normal(size=n) * 0.5 * np.exp(0.35 * a - 0.2 * b)
    y = 1 + 0.5 * a - 0.3 * b + 0.2 * d + 0.4 * d * a + 0.1 * b * b + s + level[s, g] + noise
    p = 1 / (1 + np.exp(-(-0.5 + 0.8 * a - 0.4 * d * b)))
    return pd.DataFrame(
        {"id": np.arange(n), "a": a, "b": b, "d": d, "g": g, "s": s.astype(str), "y": y, "hit": (rng.random(n) < p).astype(float)}
    )


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(5).cache()


def dense(pdf, terms=TERMS):
    columns = []
    for t in terms:
        c = pdf[t.base.driver].to_numpy() ** t.base.power if t.base.power else np.ones(len(pdf))
        columns.append(c * pdf["d"].to_numpy() if t.by_factor else c)
    return np.column_stack(columns)


def test_ols_matches_dense_in_each_stratum(table, frame):
    fits = {f.stratum: f for f in fit_ols(table, "y", {"q": TERMS}, "s")}
    assert set(fits) == {"0", "1"}
    for s, f in fits.items():
        pdf = frame[frame.s == s]
        x, y = dense(pdf), pdf.y.to_numpy()
        beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        np.testing.assert_allclose(f.beta, beta, rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose(x.T @ (y - x @ f.beta), 0, atol=1e-7)
        n, p = x.shape
        sigma2 = rss[0] / (n - p)
        np.testing.assert_allclose(f.se, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sigma2), rtol=1e-8)
        loglik = -n / 2 * (math.log(2 * math.pi * rss[0] / n) + 1)
        assert f.aic == pytest.approx(-2 * loglik + 2 * (p + 1))


def test_partitioning_does_not_matter(table):
    one = fit_ols(table.coalesce(1), "y", {"q": TERMS})[0]
    many = fit_ols(table.repartition(8), "y", {"q": TERMS})[0]
    np.testing.assert_allclose(one.beta, many.beta, rtol=1e-10)


def test_aliased_column_is_reported(spark, frame):
    pdf = frame.assign(c=2 * frame.a - frame.b)
    f = fit_ols(spark.createDataFrame(pdf), "y", {"x": model_terms(["a", "b", "c"], (), None)})[0]
    assert f.aliased == ["c"] and f.names == ["(Intercept)", "a", "b"]


def test_missing_values_are_refused(spark, frame):
    pdf = frame.copy()
    pdf.loc[3, "a"] = np.nan
    with pytest.raises(ValueError, match="incomplete"):
        fit_ols(spark.createDataFrame(pdf), "y", {"q": TERMS})


def test_unknown_term_is_refused():
    with pytest.raises(ValueError, match="no such terms"):
        model_terms(["a"], (), "d", ["d:zzz"])


def test_model_matrix_matches_dense(table, frame):
    got = model_matrix(table, TERMS, ["id"]).toPandas().sort_values("id").drop(columns="id")
    np.testing.assert_allclose(got.to_numpy(), dense(frame), rtol=1e-12)


def test_stepwise_matches_brute_force(table, frame):
    moments = cross_products(table, "y", [TERMS])
    fit, path = step_backward(moments, "", TERMS)
    y, n = frame.y.to_numpy(), len(frame)

    def aic(terms):
        x = dense(frame, terms)
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return n * math.log(r @ r / n) + 2 * x.shape[1]

    current = TERMS
    best = aic(current)
    dropped = []
    while True:
        trials = [(aic([u for u in current if u != t]), t) for t in droppable(current)]
        low = min(trials, key=lambda z: z[0])
        if low[0] >= best:
            break
        best, current = low[0], tuple(u for u in current if u != low[1])
        dropped.append(low[1].name)
    assert [p[0] for p in path[1:]] == dropped
    assert path[-1][1] == pytest.approx(best)
    assert fit.names == [t.name for t in current]


def test_marginality():
    names = [t.name for t in droppable(TERMS)]
    assert names == ["d:a", "d:b", "d:I(a^2)", "d:I(b^2)"]
    fewer = model_terms(["a", "b"], (), "d", ["d:a"])
    assert [t.name for t in droppable(fewer)] == ["a", "d:b"]


# --- variance functions ------------------------------------------------------


def dense_loglik(pdf, terms, delta, tau, reml, group=None):
    """Profiled log-likelihood with explicit n by n covariance blocks."""
    blocks = [pdf] if group is None else [p for _, p in pdf.groupby(group)]
    k = len(terms)
    xvx, xvy, yvy, logdet, n = np.zeros((k, k)), np.zeros(k), 0.0, 0.0, len(pdf)
    for p in blocks:
        x, y = dense(p, terms), p.y.to_numpy()
        e = sum(dv * p[c].to_numpy() for c, dv in delta.items()) + np.zeros(len(p))
        v = np.diag(np.exp(2 * e)) + tau * np.ones((len(p), len(p)))
        inv = np.linalg.inv(v)
        xvx, xvy, yvy = xvx + x.T @ inv @ x, xvy + x.T @ inv @ y, yvy + y @ inv @ y
        logdet += np.linalg.slogdet(v)[1]
    beta = np.linalg.solve(xvx, xvy)
    rss = yvy - beta @ xvy
    dof = n - k if reml else n
    out = -dof / 2 * (math.log(2 * math.pi * rss / dof) + 1) - logdet / 2
    return out - (np.linalg.slogdet(xvx)[1] / 2 if reml else 0.0), beta, rss / dof


@pytest.mark.parametrize("reml", [True, False])
def test_gls_is_the_maximum_of_the_dense_likelihood(spark, frame, reml):
    pdf = frame[frame.s == "0"].head(600)
    models = {"ab": VarianceModel(TERMS, ("a", "b"), reml), "a": VarianceModel(TERMS, ("a",), reml), "none": VarianceModel(TERMS, (), reml)}
    for f in fit_variance_models(spark.createDataFrame(pdf), "y", models):
        assert f.converged
        delta = {k[6:]: v for k, v in f.extra.items() if k.startswith("delta_")}
        top, beta, sigma2 = dense_loglik(pdf, TERMS, delta, 0.0, reml)
        assert f.loglik == pytest.approx(top, abs=1e-6)
        np.testing.assert_allclose(f.beta, beta, rtol=1e-6, atol=1e-8)
        assert f.sigma2 == pytest.approx(sigma2, rel=1e-8)
        for c in delta:
            for shift in (-0.01, 0.01):
                assert dense_loglik(pdf, TERMS, {**delta, c: delta[c] + shift}, 0.0, reml)[0] < top


def test_no_variance_covariate_equals_ols(table):
    gls = fit_variance_models(table, "y", {"none": VarianceModel(TERMS)})[0]
    ols = fit_ols(table, "y", {"q": TERMS})[0]
    np.testing.assert_allclose(gls.beta, ols.beta, rtol=1e-8)
    np.testing.assert_allclose(gls.se, ols.se, rtol=1e-8)


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_is_the_maximum_of_the_dense_likelihood(spark, frame, reml):
    pdf = frame[frame.s == "1"].head(600)
    f = fit_variance_models(spark.createDataFrame(pdf), "y", {"m": VarianceModel(TERMS, ("a",), reml)}, group="g")[0]
    assert f.converged
    delta, tau = {"a": f.extra["delta_a"]}, f.extra["tau2"] / f.sigma2
    top, beta, sigma2 = dense_loglik(pdf, TERMS, delta, tau, reml, "g")
    assert f.loglik == pytest.approx(top, abs=1e-5)
    np.testing.assert_allclose(f.beta, beta, rtol=1e-5, atol=1e-7)
    assert f.sigma2 == pytest.approx(sigma2, rel=1e-6)
    for t in (0.9, 1.1):
        assert dense_loglik(pdf, TERMS, delta, tau * t, reml, "g")[0] < top
    for shift in (-0.01, 0.01):
        assert dense_loglik(pdf, TERMS, {"a": delta["a"] + shift}, tau, reml, "g")[0] < top
    fixed = dense(pdf) @ f.beta
    total = fixed.var(ddof=1) + f.extra["tau2"] + f.sigma2
    assert f.extra["marginal_r2"] == pytest.approx(fixed.var(ddof=1) / total, rel=1e-8)
    assert f.extra["conditional_r2"] == pytest.approx((fixed.var(ddof=1) + f.extra["tau2"]) / total, rel=1e-8)


def test_planted_parameters_are_recovered(table, frame):
    fits = fit_variance_models(table, "y", {"m": VarianceModel(TERMS, ("a", "b"))}, stratum="s", group="g")
    for f in fits:
        assert f.extra["delta_a"] == pytest.approx(0.35, abs=0.05)
        assert f.extra["delta_b"] == pytest.approx(-0.2, abs=0.05)
        assert f.sigma2 == pytest.approx(0.25, rel=0.15)
        assert 0.1 < f.extra["tau2"] < 2.5
        by_name = dict(zip(f.names, f.beta))
        assert by_name["d:a"] == pytest.approx(0.4, abs=0.1)


def test_no_group_effect_gives_zero_variance_and_gls(spark):
    rng = np.random.default_rng(3)
    n = 800
    a = rng.normal(size=n)
    noise = rng.normal(size=n)
    g = np.arange(n) % 8
    for k in range(8):  # groups made exactly alike
        noise[g == k] -= noise[g == k].mean()
        a[g == k] -= a[g == k].mean()
    pdf = pd.DataFrame({"a": a, "g": g, "y": 1 + a + noise})
    terms = model_terms(["a"], (), None)
    df = spark.createDataFrame(pdf)
    mixed = fit_variance_models(df, "y", {"m": VarianceModel(terms)}, group="g")[0]
    plain = fit_variance_models(df, "y", {"m": VarianceModel(terms)})[0]
    assert mixed.extra["tau2"] == pytest.approx(0, abs=1e-8)
    np.testing.assert_allclose(mixed.beta, plain.beta, rtol=1e-6, atol=1e-9)
    assert mixed.aic == pytest.approx(plain.aic + 2, abs=1e-6)


# --- logistic ----------------------------------------------------------------


def test_logistic_score_is_zero_and_matches_spark_ml(spark, table, frame):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    fits = fit_logistic(table, "hit", {"q": TERMS, "l": model_terms(["a", "b"], (), "d")}, "s")
    assert len(fits) == 4
    for f in [f for f in fits if f.label == "q"]:
        pdf = frame[frame.s == f.stratum]
        x, y = dense(pdf), pdf.hit.to_numpy()
        mu = 1 / (1 + np.exp(-x @ f.beta))
        np.testing.assert_allclose(x.T @ (y - mu), 0, atol=1e-6)
        far = variance_distance(y, mu).sum() / variance_distance(y, np.full(len(y), y.mean())).sum()
        assert f.extra["r2_variance"] == pytest.approx(1 - far, rel=1e-8)
    names = [t.name for t in TERMS if t.name != "(Intercept)"]
    wide = model_matrix(table.where("s = '0'"), TERMS, ["hit"])
    features = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(
        wide.toDF("hit", "one", *[f"f{i}" for i in range(len(names))])
    )
    ml = GeneralizedLinearRegression(family="binomial", labelCol="hit", maxIter=50, tol=1e-12).fit(features)
    mine = next(f for f in fits if f.label == "q" and f.stratum == "0")
    np.testing.assert_allclose(mine.beta[1:], ml.coefficients.toArray(), rtol=1e-5, atol=1e-7)
    assert mine.aic == pytest.approx(ml.summary.aic, rel=1e-8)
    np.testing.assert_allclose(mine.se[0], ml.summary.coefficientStandardErrors[-1], rtol=1e-5)


# --- additive models ---------------------------------------------------------


def gam_design(pdf, fit):
    columns = [np.ones((len(pdf), 1)), pdf[["d"]].to_numpy()]
    columns += [s.basis(pdf[v].to_numpy()) for v, s in fit.splines.items()]
    return np.hstack(columns)


def test_gam_with_infinite_penalty_is_linear(table, frame):
    gam = fit_gam(table, "y", ["a", "b"], factor="d", log_lambda=20.0)[0]
    line = fit_ols(table.withColumn("one", F.lit(1)), "y", {"l": model_terms(["d", "a", "b"], (), None)})[0]
    assert gam.edf == pytest.approx(4, abs=1e-3)
    assert gam.parametric[1]["estimate"] == pytest.approx(dict(zip(line.names, line.beta))["d"], abs=1e-4)
    assert gam.sigma2 == pytest.approx(line.sigma2, rel=1e-4)


def test_gam_matches_a_dense_penalised_fit(table, frame):
    gam = fit_gam(table, "y", ["a", "b"], factor="d")[0]
    x, y = gam_design(frame, gam), frame.y.to_numpy()
    beta = np.array([c["estimate"] for c in gam.coefficients])
    fitted = x @ beta
    n = len(y)
    assert gam.gcv == pytest.approx(n * ((y - fitted) ** 2).sum() / (n - gam.edf) ** 2, rel=1e-6)
    for v, s in gam.splines.items():  # smooths are centred
        at = [i for i, c in enumerate(gam.coefficients) if c["term"].startswith(f"s({v})")]
        assert abs((x[:, at] @ beta[at]).mean()) < 1e-8
    for other in (2.0, 12.0):  # no common smoothing beats the chosen ones
        assert gam.gcv <= fit_gam(table, "y", ["a", "b"], factor="d", log_lambda=other)[0].gcv + 1e-9


def test_gam_by_stratum_with_its_own_smooths(table):
    fits = {g.stratum: g for g in fit_gam(table, "y", {"0": ["a"], "1": ["a", "b"]}, "s", factor="d")}
    assert [s["term"] for s in fits["0"].smooths] == ["s(a)"]
    assert [s["term"] for s in fits["1"].smooths] == ["s(a)", "s(b)"]


def test_gam_of_a_mostly_zero_driver(spark, frame):
    pdf = frame.assign(z=np.where(np.arange(len(frame)) % 20 == 0, np.abs(frame.b), 0.0))
    gam = fit_gam(spark.createDataFrame(pdf), "y", ["a", "z"], factor="d")[0]
    assert len(gam.splines["z"].knots) == 10
    assert all(0.9 < s["edf"] < 9 for s in gam.smooths)


def test_too_few_rows_are_refused(spark, frame):
    few = spark.createDataFrame(frame.head(3))
    with pytest.raises(ValueError, match="too few"):
        fit_ols(few, "y", {"q": TERMS})
    with pytest.raises(ValueError, match="too few"):
        fit_variance_models(few, "y", {"q": VarianceModel(TERMS, ("a",))})


def test_extreme_variance_stays_finite(spark):
    rng = np.random.default_rng(11)
    a = rng.standard_t(2, 3000) * 3
    pdf = pd.DataFrame({"a": a, "y": 1 + 0.1 * a + rng.normal(size=3000) * np.exp(0.2 * np.clip(a, -8, 8))})
    f = fit_variance_models(spark.createDataFrame(pdf), "y", {"m": VarianceModel(model_terms(["a"], (), None), ("a",))})[0]
    assert math.isfinite(f.loglik) and f.extra["delta_a"] > 0.05


def test_spline_reproduces_lines_and_its_knots():
    s = Spline([0, 1, 3, 4, 8])
    x = np.linspace(0, 8, 33)
    np.testing.assert_allclose(s.basis(x) @ (2 * s.knots + 1), 2 * x + 1, atol=1e-12)
    np.testing.assert_allclose(s.basis(s.knots), np.eye(5), atol=1e-12)
    assert np.abs(s.penalty @ s.knots).max() < 1e-12


# --- diagnostics and storage -------------------------------------------------


def test_influence_matches_dense(table, frame):
    fit = fit_ols(table, "y", {"q": TERMS})[0]
    got = D.influence(table, fit, TERMS, "y", ["id"]).toPandas().sort_values("id")
    x, y = dense(frame), frame.y.to_numpy()
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    r = y - x @ fit.beta
    np.testing.assert_allclose(got.leverage, h, rtol=1e-8)
    np.testing.assert_allclose(got.cook, r**2 * h / (x.shape[1] * fit.sigma2 * (1 - h) ** 2), rtol=1e-6)
    top = [row["id"] for row in D.most_influential(D.influence(table, fit, TERMS, "y", ["id"]), ["id"], 4).collect()]
    assert top == list(got.sort_values("cook", ascending=False).id[:4])


def test_weighted_residuals_have_unit_spread(table):
    fit = fit_variance_models(table, "y", {"m": VarianceModel(TERMS, ("a", "b"))})[0]
    out = D.with_residuals(table, fit, TERMS, "y").agg(F.stddev("standardised"), F.avg("residual")).first()
    assert out[0] == pytest.approx(1, abs=0.02)
    assert sum(r["N"] for r in D.binned_residuals(D.with_residuals(table, fit, TERMS, "y"), 10).collect()) == 4000


def test_logistic_residuals(table):
    terms = model_terms(["a", "b"], (), "d")
    fit = fit_logistic(table, "hit", {"l": terms})[0]
    total = D.with_residuals(table, fit, terms, "hit").agg(F.sum(F.col("residual") ** 2)).first()[0]
    assert total == pytest.approx(fit.extra["deviance"], rel=1e-9)


def test_saved_fits_come_back(spark, table, tmp_path):
    fits = fit_ols(table, "y", {"q": TERMS}, "s")
    for _ in range(2):  # saving again replaces
        report.save_fits(spark, fits, str(tmp_path), "y")
    again = sorted(report.load_fits(spark, str(tmp_path), "y"), key=lambda f: f.stratum)
    for a, b in zip(sorted(fits, key=lambda f: f.stratum), again):
        np.testing.assert_array_equal(a.beta, b.beta)
        np.testing.assert_array_equal(a.covariance, b.covariance)
        assert (a.names, a.n, a.aic) == (b.names, b.n, b.aic)


def test_ols_report_layout(spark, table):
    fit = fit_ols(table, "y", {"q": TERMS})[0]
    lines = [tuple(r) for r in report.ols_report(spark, fit, "y ~ d * a").orderBy("line").collect()]
    assert lines[0][1:] == ("y ~ d * a", f"F({len(TERMS) - 1},{4000 - len(TERMS)})", "Prob > P", "R-Squared", "Adj-R2")
    assert lines[1][4] == f"{fit.extra['r2']:.8f}"
    assert lines[4][1:3] == ("(Intercept)", f"{fit.beta[0]:.8f}")
    assert len(lines) == 4 + len(TERMS)


def test_ols_of_reuses_moments(table):
    moments = cross_products(table, "y", [TERMS], "s")
    sub = model_terms(["a"], (), "d")
    assert ols_of(moments, "0", sub).names == ["(Intercept)", "d", "a", "d:a"]


def test_one_name_per_stratum(spark):
    """Boolean, numeric, text and missing strata have the same names in every model family."""
    from emberframe.operators import sums

    rng = np.random.default_rng(4)
    rows = [(float(x), float(2 * x + e), float(x + e > 0), i) for i, (x, e) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "x double, y double, z double, i int").repartition(7)
    terms = model_terms(("x",), (), None)
    for key in ("i % 2 = 0", "nullif(i % 3, 0)", "CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' END", "i % 2 * 1e20", "CASE i % 3 WHEN 0 THEN '<missing>' WHEN 1 THEN 'a' END"):
        cut = df.withColumn("s", F.expr(key))
        names = sorted(sums.strata_of(cut, "s"))
        linear = fit_ols(cut, "y", {"m": terms}, "s")
        assert sorted(f.stratum for f in linear) == names
        assert sorted(f.stratum for f in fit_variance_models(cut, "y", {"m": VarianceModel(terms)}, "s")) == names
        assert sorted(f.stratum for f in fit_logistic(cut, "z", {"m": terms}, "s")) == names
        assert sum(f.n for f in linear) == 400
