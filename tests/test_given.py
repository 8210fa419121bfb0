"""Evaluation at given parameters, group effects, leverage, downdating and stored additive models against dense NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberframe.operators import diagnose as D
from emberframe.operators.design import model_terms
from emberframe.operators.gam import Spline, fit_gam, predict_gam, spline_columns
from emberframe.operators.logistic import fit_logistic
from emberframe.operators.ols import collinear, cross_products, fit_ols, ols_of, step_backward
from emberframe.operators.panel import without_rows
from emberframe.operators.variance import Given, VarianceModel, evaluate_variance_models, fit_variance_models
from emberframe.sources import report

from test_models import TERMS, dense, dense_loglik, frame, table  # noqa: F401


@pytest.mark.parametrize("reml", [True, False])
def test_given_parameters_have_the_dense_likelihood(spark, frame, reml):
    pdf = frame.head(900)
    models = {"ab": VarianceModel(TERMS, ("a", "b"), reml), "none": VarianceModel(TERMS, (), reml)}
    at = {"ab": Given((0.3, -0.1), 0.7), ("1", "ab"): Given((0.1, 0.2), 0.0), "none": Given((), 1.5)}
    fits = evaluate_variance_models(spark.createDataFrame(pdf), "y", models, at, "s", "g")
    assert len(fits) == 4
    for f in fits:
        p = at.get((f.stratum, f.label), at[f.label])
        part = pdf[pdf.s == f.stratum]
        top, beta, sigma2 = dense_loglik(part, TERMS, dict(zip(models[f.label].covariates, p.delta)), p.ratio, reml, "g")
        assert f.loglik == pytest.approx(top, abs=1e-7) and f.sigma2 == pytest.approx(sigma2, rel=1e-9) and f.passes == 1
        np.testing.assert_allclose(f.beta, beta, rtol=1e-8, atol=1e-10)
        assert f.extra["tau2"] == pytest.approx(p.ratio * f.sigma2)


def test_evaluation_at_the_fitted_parameters_is_the_fit(table):
    models = {"m": VarianceModel(TERMS, ("a", "b"))}
    (fit,) = fit_variance_models(table, "y", models, group="g")
    at = Given((fit.extra["delta_a"], fit.extra["delta_b"]), fit.extra["tau2"] / fit.sigma2)
    (again,) = evaluate_variance_models(table, "y", models, {"m": at}, group="g")
    assert again.aic == pytest.approx(fit.aic, abs=1e-8) and again.kind == fit.kind
    np.testing.assert_allclose(again.covariance, fit.covariance, rtol=1e-9)
    for k, v in fit.extra.items():
        assert again.extra[k] == pytest.approx(v, rel=1e-9)
    assert again.effects == pytest.approx(fit.effects)


def test_given_parameters_must_fit_the_model(table):
    models = {"m": VarianceModel(TERMS, ("a",))}
    for at, group in (({}, None), ({"m": Given((0.1, 0.2))}, None), ({"m": Given((0.1,), 0.5)}, None)):
        with pytest.raises(ValueError):
            evaluate_variance_models(table, "y", models, at, group=group)


def dense_effects(pdf, fit, delta):
    """tau^2 Z' V^-1 (y - X beta), group by group."""
    out = {}
    for g, p in pdf.groupby("g"):
        e = sum(d * p[c].to_numpy() for c, d in delta.items())
        v = fit.sigma2 * np.diag(np.exp(2 * e)) + fit.extra["tau2"]
        out[str(g)] = fit.extra["tau2"] * np.linalg.solve(v, p.y.to_numpy() - dense(p) @ fit.beta).sum()
    return out


def test_group_effects_and_residuals_match_dense(spark, frame):
    pdf = frame[frame.s == "0"].head(700)
    df = spark.createDataFrame(pdf)
    (fit,) = fit_variance_models(df, "y", {"m": VarianceModel(TERMS, ("a",))}, group="g")
    want = dense_effects(pdf, fit, {"a": fit.extra["delta_a"]})
    assert fit.effects == pytest.approx(want, rel=1e-6) and max(map(abs, want.values())) > 0.2
    got = D.with_residuals(df, fit, TERMS, "y").toPandas().sort_values("id")
    inside = pdf.sort_values("id")
    fitted = dense(inside) @ fit.beta + inside.g.astype(str).map(want).to_numpy()
    np.testing.assert_allclose(got.fitted, fitted, rtol=1e-6)
    np.testing.assert_allclose(got.residual, inside.y - fitted, atol=1e-6)
    np.testing.assert_allclose(got.standardised, (inside.y - fitted) / np.sqrt(fit.sigma2) / np.exp(fit.extra["delta_a"] * inside.a), atol=1e-5)
    fixed = D.with_residuals(df, fit, TERMS, "y", by_group=False).toPandas().sort_values("id")
    np.testing.assert_allclose(fixed.fitted, dense(inside) @ fit.beta, rtol=1e-6)
    assert set(got.columns) == {*pdf.columns, "fitted", "residual", "standardised"}


def test_effects_of_missing_and_unknown_groups(spark, frame):
    pdf = frame.head(600).assign(g=frame.g.where(frame.g != 3).astype("Int64").astype(object).where(frame.g != 3, None))
    df = spark.createDataFrame(pdf[["id", "a", "b", "d", "y", "g"]], "id long, a double, b double, d double, y double, g long")
    (fit,) = fit_variance_models(df, "y", {"m": VarianceModel(TERMS)}, group="g")
    assert len(fit.effects) == 6
    out = D.with_residuals(df, fit, TERMS, "y").withColumn("fixed", D.linear_predictor(fit, TERMS))
    missing = {round(r[0], 9) for r in out.where("g IS NULL").select(F.col("fitted") - F.col("fixed")).collect()}
    assert len(missing) == 1 and missing != {0.0}
    new = out.select("id", "a", "b", "d", "y", F.lit(99).alias("g"))
    assert D.with_residuals(new, fit, TERMS, "y").where(F.abs(F.col("fitted") - D.linear_predictor(fit, TERMS)) > 1e-12).isEmpty()
    fit.effects = {}
    with pytest.raises(ValueError):
        D.with_residuals(df, fit, TERMS, "y")


def test_saved_mixed_models_keep_their_effects(spark, table, tmp_path):
    fits = fit_variance_models(table, "y", {"m": VarianceModel(TERMS, ("a",))}, "s", "g")
    report.save_fits(spark, fits, str(tmp_path), "y")
    again = {f.stratum: f for f in report.load_fits(spark, str(tmp_path), "y")}
    for f in fits:
        assert again[f.stratum].effects == f.effects and again[f.stratum].group == "g"
    # saving the response again drops strata that it no longer has
    report.save_fits(spark, fits[:1], str(tmp_path), "y")
    report.save_fits(spark, fits[1:], str(tmp_path), "z")
    assert [f.stratum for f in report.load_fits(spark, str(tmp_path), "y")] == [fits[0].stratum]


def test_leverage_of_weighted_and_logistic_fits(table, frame):
    x = dense(frame)
    (gls,) = evaluate_variance_models(table, "y", {"m": VarianceModel(TERMS, ("a", "b"))}, {"m": Given((0.3, -0.2))})
    w = np.exp(-2 * (0.3 * frame.a - 0.2 * frame.b)).to_numpy()
    h = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ (x * w[:, None])), x)
    r = frame.y.to_numpy() - x @ gls.beta
    got = D.influence(table, gls, TERMS, "y", ["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(got.leverage, h, rtol=1e-7)
    np.testing.assert_allclose(got.standardised, r * np.sqrt(w / (gls.sigma2 * (1 - h))), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got.cook, r**2 * w * h / (x.shape[1] * gls.sigma2 * (1 - h) ** 2), rtol=1e-6, atol=1e-12)
    assert got.leverage.sum() == pytest.approx(x.shape[1])

    (fit,) = fit_logistic(table, "hit", {"l": TERMS})
    mu = 1 / (1 + np.exp(-(x @ fit.beta)))
    w = mu * (1 - mu)
    h = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ (x * w[:, None])), x)
    got = D.influence(table, fit, TERMS, "hit", ["id"]).toPandas().sort_values("id")
    y = frame.hit.to_numpy()
    deviance = np.sign(y - mu) * np.sqrt(-2 * np.log(np.where(y > 0.5, mu, 1 - mu)))
    np.testing.assert_allclose(got.leverage, h, rtol=1e-6)
    np.testing.assert_allclose(got.residual, deviance, rtol=1e-7)
    np.testing.assert_allclose(got.standardised, deviance / np.sqrt(1 - h), rtol=1e-6)
    np.testing.assert_allclose(got.cook, (y - mu) ** 2 / w * h / (x.shape[1] * (1 - h) ** 2), rtol=1e-6)


def test_downdated_refit_equals_a_refit_of_the_rows(table):
    moments = cross_products(table, "y", [TERMS], "s")
    fit = ols_of(moments, "0", TERMS)
    mine = table.where("s = '0'")
    top = D.most_influential(D.influence(mine, fit, TERMS, "y", ["id"]), ["id"], 40).select("id")
    less = moments.without(table.join(top, "id", "left_semi"), "y", "s")
    again = cross_products(without_rows(table, top, ["id"]), "y", [TERMS], "s")
    for s in ("0", "1"):
        a, b = ols_of(less, s, TERMS), ols_of(again, s, TERMS)
        assert a.n == b.n == ols_of(moments, s, TERMS).n - (40 if s == "0" else 0)
        np.testing.assert_allclose(a.beta, b.beta, rtol=1e-9, atol=1e-11)
        one, two = step_backward(less, s, TERMS), step_backward(again, s, TERMS)
        assert one[0].names == two[0].names
        assert [t for t, _ in one[1]] == [t for t, _ in two[1]]


def test_downdating_reads_no_data_again(spark, table, monkeypatch):
    """The removed rows are all that is read."""
    moments = cross_products(table, "y", [TERMS])
    read = []
    from emberframe.operators import ols

    counted = ols.sum_blocks
    monkeypatch.setattr(ols, "sum_blocks", lambda df, *a: (read.append(df.count()), counted(df, *a))[1])
    step_backward(moments.without(table.where("id < 7"), "y"), "", TERMS)
    assert read == [7]


def test_collinear_pairs_of_each_stratum(spark, frame):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=len(frame)) * np.where(frame.s == "0", 0.1, 3.0)
    pdf = frame.assign(c=frame.a + noise, e=-frame.a)
    moments = cross_products(spark.createDataFrame(pdf), "y", [model_terms(["a", "b", "c", "e"], (), "d")], "s")
    found = collinear(moments, ["a", "b", "c", "e"])
    assert [(s, a, b) for s, a, b, _ in found] == [("0", "a", "c")]
    part = pdf[pdf.s == "0"]
    assert found[0][3] == pytest.approx(np.corrcoef(part.a, part.c)[0, 1], rel=1e-9)


def test_binned_residuals_and_profiles_by_group(table, frame):
    (fit,) = fit_ols(table, "y", {"q": TERMS})
    residuals = D.with_residuals(table, fit, TERMS, "y")
    by = D.binned_residuals(residuals, 7, keys=["s"]).toPandas()
    for s in ("0", "1"):
        alone = D.binned_residuals(residuals.where(F.col("s") == s), 7).toPandas().sort_values("bin").reset_index(drop=True)
        mine = by[by.s == s].drop(columns="s").sort_values("bin").reset_index(drop=True)
        pd.testing.assert_frame_equal(mine, alone)
    profile = D.driver_profile(table, "y", ["a", "b"], 5, keys=["s"]).toPandas()
    alone = D.driver_profile(table.where("s = '1'"), "y", ["a", "b"], 5).toPandas().sort_values(["variable", "bin"]).reset_index(drop=True)
    mine = profile[profile.s == "1"].drop(columns="s").sort_values(["variable", "bin"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(mine, alone)


# --- additive models ----------------------------------------------------------


def test_expressions_equal_the_basis(spark):
    spline = Spline([-1.0, 0.0, 0.5, 2.0, 7.0])
    x = np.array([-3.0, -1.0, -0.3, 0.0, 0.2, 0.5, 1.9, 2.0, 6.5, 7.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    rows = [list(r) for r in spline_columns(df, {"x": spline}).collect()]
    np.testing.assert_allclose(np.array(rows[:-1]), spline.basis(x), atol=1e-12)
    assert rows[-1] == [None] * 5
    values = np.array([1.0, -2.0, 0.5, 3.0, 1.0])
    got = [r[0] for r in df.select(spline.column(F.col("x"), values)).collect()[:-1]]
    np.testing.assert_allclose(got, spline.basis(x) @ values, atol=1e-12)
    # beyond the knots the curve is a straight line that goes on with the same slope
    line = spline.basis(np.array([7.0 - 1e-6, 7.0, 8.0, 9.0])) @ values
    assert line[3] - line[2] == pytest.approx(line[2] - line[1]) == pytest.approx((line[1] - line[0]) / 1e-6, rel=1e-4)


def test_penalty_is_the_weight_of_the_curvature(table, frame):
    (fit,) = fit_gam(table, "y", ["a", "b"], factor="d", knots=6, penalty=3.0)
    parts = [np.ones((len(frame), 1)), frame[["d"]].to_numpy()] + [fit.splines[c].basis(frame[c].to_numpy()) for c in ("a", "b")]
    x, y = np.hstack(parts), frame.y.to_numpy()
    beta = np.array([c["estimate"] for c in fit.coefficients])
    score = x.T @ (y - x @ beta)
    for i, c in enumerate(("a", "b")):
        at = slice(2 + 6 * i, 8 + 6 * i)
        score[at] -= 3.0 * fit.splines[c].penalty @ beta[at]
        assert fit.penalties[c] == pytest.approx(3.0)
        assert parts[2 + i].sum(axis=0) @ beta[at] == pytest.approx(0, abs=1e-6)
    np.testing.assert_allclose(score, 0, atol=1e-6)
    with pytest.raises(ValueError):
        fit_gam(table, "y", ["a"], factor="d", log_lambda=0.0, penalty=1.0)


def test_stored_additive_models_predict_alike(spark, table, frame, tmp_path):
    fits = fit_gam(table, "y", {"0": ["a", "b"], "1": ["b"]}, "s", factor="d", knots=5)
    report.save_gams(spark, fits, str(tmp_path), "y")
    report.save_gams(spark, fits, str(tmp_path), "y")
    again = report.load_gams(spark, str(tmp_path), "y")
    assert [g.stratum for g in again] == ["0", "1"] and all(g.converged for g in again)
    for f, g in zip(fits, again):
        assert f.estimates() == g.estimates() and f.penalties == pytest.approx(g.penalties)
        np.testing.assert_array_equal(f.covariance, g.covariance)
    both = predict_gam(predict_gam(table, fits, "s"), again, "s", "later")
    assert both.where("fitted IS NULL OR fitted <> later").isEmpty()
    rss = both.where("s = '0'").agg(F.sum(F.pow(F.col("y") - F.col("fitted"), 2))).first()[0]
    part = frame[frame.s == "0"]
    assert 1 - rss / ((part.y - part.y.mean()) ** 2).sum() == pytest.approx(fits[0].r2, rel=1e-8)
    assert predict_gam(table.withColumn("s", F.lit("9")), again, "s").where("fitted IS NOT NULL").isEmpty()
