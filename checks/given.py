"""Variance functions, random intercepts and additive models at given parameters, where SQL has closed forms."""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.lineage import materialise, new_folder
from emberframe.operators import diagnose as D
from emberframe.operators.design import model_terms
from emberframe.operators.gam import Spline, fit_gam, predict_gam, spline_columns
from emberframe.operators.logistic import fit_logistic
from emberframe.operators.ols import cross_products, fit_ols, ols_of, step_backward
from emberframe.operators.ranks import quantiles
from emberframe.operators.variance import Given, VarianceModel, evaluate_variance_models
from emberframe.sources import report

from .fixtures import MODEL_ROWS, ORDER_ROWS, check, model_rows, order_rows, with_sql
from .models import ORDER_FIT, V, newton_sql

ONE = model_terms(["l_quantity"], factor=None)
NONE = model_terms([], factor=None)
GROUP = "s_nationkey"
RATIO = 0.05
BY_DISCOUNT = (("l_discount", 2.5),)
COMBINED = (("l_discount", 2.5), ("l_tax", -1.5))


def model(deltas=(), terms=ONE, reml=True):
    return VarianceModel(terms, tuple(c for c, _ in deltas), reml)


def given(deltas=(), ratio=0.0):
    return Given(tuple(d for _, d in deltas), ratio)


def weighted_sql(deltas=(), ratio=0.0, reml=True, stratum="p_brand", group="''", driver=True, prefix=""):
    """One-driver (or constant) model by weighted sums per group, ending in the table ``{prefix}q``.

    With V = W^-1 + ratio * 11' inside a group, 1'V^-1 and X'V^-1X follow from the
    group's weighted sums; c = ratio / (1 + ratio * sum of weights).
    """
    log_w = " + ".join(["0.0::DOUBLE", *[f"(-2.0 * {d} * {c})" for c, d in deltas]])
    p, k = (2 if driver else 1), len(deltas) + (1 if group != "''" else 0)
    x = "l_quantity" if driver else "0.0::DOUBLE"
    dof = f"(n - {p})" if reml else "n"
    det = "(a00 * a11 - a01 * a01)" if driver else "a00"
    z = prefix
    return [
        f"""{z}w AS (SELECT *, {stratum} AS stratum, {group} AS g, {x} AS x, exp({log_w}) AS w, {log_w} AS lw FROM rows_)""",
        f"""{z}s AS (SELECT stratum, g, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy,
  sum(w * x * y) AS sxy, sum(w * y * y) AS syy, sum(lw) AS lw, sum(x) AS ux, sum(x * x) AS uxx, {ratio}::DOUBLE / (1 + {ratio} * sum(w)) AS c
  FROM {z}w GROUP BY stratum, g)""",
        f"""{z}t AS (SELECT stratum, sum(n) AS n, sum(lw) AS lw, sum(ln(1 + {ratio} * s)) AS lv, sum(s - c * s * s) AS a00, sum(sx - c * s * sx) AS a01,
  sum(sxx - c * sx * sx) AS a11, sum(sy - c * s * sy) AS b0, sum(sxy - c * sx * sy) AS b1, sum(syy - c * sy * sy) AS yy, sum(ux) AS ux, sum(uxx) AS uxx
  FROM {z}s GROUP BY stratum)""",
        f"""{z}b AS (SELECT *, {det} AS det, {'(a11 * b0 - a01 * b1) / det' if driver else 'b0 / a00'} AS beta0,
  {'(a00 * b1 - a01 * b0) / det' if driver else '0.0::DOUBLE'} AS beta1 FROM {z}t)""",
        f"""{z}r AS (SELECT *, yy - beta0 * b0 - beta1 * b1 AS rss, (yy - beta0 * b0 - beta1 * b1) / {dof} AS s2 FROM {z}b)""",
        f"""{z}q AS (SELECT *, -{dof} / 2.0 * (ln(2 * pi() * s2) + 1) + lw / 2 - lv / 2 {'- ln(det) / 2' if reml else ''} AS loglik,
  {p + 1 + k} AS parameters, beta1 * beta1 * (uxx - ux * ux / n) / (n - 1) AS fixed, {ratio} * s2 AS between_, sqrt(s2 * a11 / det) AS se0,
  sqrt(s2 * a00 / det) AS se1 FROM {z}r)""",
    ]


SUMMARY = """SELECT stratum AS p_brand, CAST(n AS BIGINT) AS n, round(beta0, 6) AS intercept, round(se0, 7) AS intercept_error, round(beta1, 8) AS slope,
  round(se1, 8) AS slope_error, round(sqrt(s2), 6) AS sigma, round(loglik, 4) AS loglik, round(2 * parameters - 2 * loglik, 4) AS aic FROM q"""
DIGITS = {"intercept": 6, "intercept_error": 7, "slope": 8, "slope_error": 8, "sigma": 6, "loglik": 4, "aic": 4}


def summarised(spark, fits):
    rows = [(f.stratum, f.n, *map(float, (f.beta[0], f.se[0], f.beta[1], f.se[1], f.sigma2**0.5, f.loglik, f.aic))) for f in fits]
    table = spark.createDataFrame(rows, "p_brand string, n bigint, " + ", ".join(f"{c} double" for c in DIGITS))
    return table.withColumns({c: F.round(c, d) for c, d in DIGITS.items()})


def evaluated(spark, folder, label, deltas, ratio=0.0, reml=True, stratum="p_brand", group=None, terms=ONE):
    rows = model_rows(spark, folder)
    return evaluate_variance_models(rows, "y", {label: model(deltas, terms, reml)}, {label: given(deltas, ratio)}, stratum, group)


@check("ML7 ML4", with_sql(MODEL_ROWS, *weighted_sql(BY_DISCOUNT)) + SUMMARY)
def exponential_variance_at(spark, folder):
    """Variance exponential in one covariate, at a given rate, in every stratum."""
    return summarised(spark, evaluated(spark, folder, "exp", BY_DISCOUNT))


@check("ML8 ML4", with_sql(MODEL_ROWS, *weighted_sql(COMBINED)) + SUMMARY)
def combined_variance_at(spark, folder):
    """Product of two exponential variance functions at given rates."""
    return summarised(spark, evaluated(spark, folder, "combined", COMBINED))


@check("ML9 ML4", with_sql(MODEL_ROWS, *weighted_sql(COMBINED, RATIO, group=GROUP)) + SUMMARY)
def random_intercept_at(spark, folder):
    """Random intercept by nation under a combined variance function, at given parameters."""
    return summarised(spark, evaluated(spark, folder, "mixed", COMBINED, RATIO, group=GROUP))


@check("ML10 ML4", with_sql(MODEL_ROWS, *weighted_sql(COMBINED, RATIO, reml=False, group=GROUP)) + SUMMARY)
def maximum_likelihood_at(spark, folder):
    """The same model by maximum likelihood."""
    return summarised(spark, evaluated(spark, folder, "mixed", COMBINED, RATIO, reml=False, group=GROUP))


def compared(spark, folder):
    """Both formulas by maximum likelihood in every stratum: {stratum: fits, best first}."""
    rows = model_rows(spark, folder)
    models = {"driver": model(COMBINED, ONE, False), "constant": model(COMBINED, NONE, False)}
    fits = evaluate_variance_models(rows, "y", models, {k: given(COMBINED, RATIO) for k in models}, "p_brand", GROUP)
    out = {}
    for f in sorted(fits, key=lambda f: (f.stratum, f.aic, f.label)):
        out.setdefault(f.stratum, []).append(f)
    return rows, models, out


BOTH = [*weighted_sql(COMBINED, RATIO, reml=False, group=GROUP), *weighted_sql(COMBINED, RATIO, reml=False, group=GROUP, driver=False, prefix="c")]
PLACED = """a AS (SELECT stratum, 'driver' AS label, 2 * parameters - 2 * loglik AS aic FROM q UNION ALL SELECT stratum, 'constant', 2 * parameters - 2 * loglik FROM cq),
placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY aic, label) AS place FROM a)"""


@check("ML11 SL3", with_sql(MODEL_ROWS, *BOTH, PLACED) + "SELECT stratum AS p_brand, label, round(aic, 4) AS aic, CAST(place AS INT) AS place FROM placed")
def formulas_compared_at(spark, folder):
    """Stated fixed parts of the mixed model ranked by AIC in every stratum."""
    _, _, ranked = compared(spark, folder)
    rows = [(s, f.label, float(f.aic), i + 1) for s, fits in ranked.items() for i, f in enumerate(fits)]
    return spark.createDataFrame(rows, "p_brand string, label string, aic double, place int").withColumn("aic", F.round("aic", 4))


REFIT = [*weighted_sql(COMBINED, RATIO, group=GROUP, prefix="d"), *weighted_sql(COMBINED, RATIO, group=GROUP, driver=False, prefix="e")]


@check(
    "ML12",
    with_sql(MODEL_ROWS, *BOTH, PLACED, *REFIT)
    + """SELECT stratum AS p_brand, label, round(CASE label WHEN 'driver' THEN dq.beta0 ELSE eq.beta0 END, 6) AS intercept,
  round(CASE label WHEN 'driver' THEN dq.beta1 END, 8) AS slope, round(sqrt(CASE label WHEN 'driver' THEN dq.s2 ELSE eq.s2 END), 6) AS sigma,
  round(CASE label WHEN 'driver' THEN dq.loglik ELSE eq.loglik END, 4) AS loglik
FROM placed JOIN dq USING (stratum) JOIN eq USING (stratum) WHERE place = 1""",
)
def restricted_refit_at(spark, folder):
    """The fixed part that maximum likelihood prefers in a stratum, refitted by restricted likelihood."""
    rows, models, ranked = compared(spark, folder)
    final = {k: VarianceModel(m.terms, m.covariates) for k, m in models.items()}
    only = {s: [fits[0].label] for s, fits in ranked.items()}
    fits = evaluate_variance_models(rows, "y", final, {k: given(COMBINED, RATIO) for k in final}, "p_brand", GROUP, only)
    out = [(f.stratum, f.label, float(f.beta[0]), float(f.beta[1]) if len(f.beta) > 1 else None, float(f.sigma2**0.5), float(f.loglik)) for f in fits]
    table = spark.createDataFrame(out, "p_brand string, label string, intercept double, slope double, sigma double, loglik double")
    return table.withColumns({c: F.round(c, DIGITS[c]) for c in ("intercept", "slope", "sigma", "loglik")})


@check(
    "ML13",
    with_sql(MODEL_ROWS, *weighted_sql(BY_DISCOUNT, RATIO, group=GROUP))
    + """SELECT stratum AS p_brand, round(fixed / (fixed + between_ + s2), 8) AS marginal_r2,
  round((fixed + between_) / (fixed + between_ + s2), 8) AS conditional_r2 FROM q""",
)
def mixed_r_squared_at(spark, folder):
    """Marginal and conditional R-squared of the mixed model in every stratum."""
    fits = evaluated(spark, folder, "mixed", BY_DISCOUNT, RATIO, group=GROUP)
    rows = [(f.stratum, float(f.extra["marginal_r2"]), float(f.extra["conditional_r2"])) for f in fits]
    table = spark.createDataFrame(rows, "p_brand string, marginal_r2 double, conditional_r2 double")
    return table.withColumns({c: F.round(c, 8) for c in ("marginal_r2", "conditional_r2")})


WHOLE = weighted_sql(BY_DISCOUNT, RATIO, stratum="''", group=GROUP)
EFFECTS = "e AS (SELECT g, c * (sy - beta0 * s - beta1 * sx) AS effect, s.n AS n FROM s, q)"


@check(
    "ML9 ML19",
    with_sql(MODEL_ROWS, *WHOLE, EFFECTS) + "SELECT CAST(g AS VARCHAR) AS s_nationkey, round(effect, 7) AS effect FROM e",
)
def group_effects(spark, folder):
    """Predicted intercept of every nation."""
    (fit,) = evaluated(spark, folder, "mixed", BY_DISCOUNT, RATIO, stratum=None, group=GROUP)
    return spark.createDataFrame(list(fit.effects.items()), "s_nationkey string, effect double").withColumn("effect", F.round("effect", 7))


@check(
    "ML19 ML22",
    with_sql(MODEL_ROWS, *WHOLE, EFFECTS)
    + """SELECT l_orderkey, l_linenumber, round(beta0 + beta1 * x + effect, 6) AS fitted, round(y - (beta0 + beta1 * x + effect), 6) AS residual,
  round((y - (beta0 + beta1 * x + effect)) * sqrt(w / s2), 6) AS standardised, round(beta0 + beta1 * x, 6) AS fixed_part
FROM w JOIN e USING (g), q""",
)
def mixed_residuals(spark, folder):
    """Residuals of the mixed model about its fitted values with the nation's intercept."""
    (fit,) = evaluated(spark, folder, "mixed", BY_DISCOUNT, RATIO, stratum=None, group=GROUP)
    out = D.with_residuals(model_rows(spark, folder), fit, ONE, "y").withColumn("fixed_part", D.linear_predictor(fit, ONE))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("fitted", "residual", "standardised", "fixed_part")])


@check(
    "ML22 ML19",
    with_sql(MODEL_ROWS, *weighted_sql(COMBINED, stratum="''"))
    + """, v AS (SELECT beta0 + beta1 * x AS fitted, (y - (beta0 + beta1 * x)) * sqrt(w / s2) AS standardised FROM w, q),
ends AS (SELECT min(fitted) AS lo, (max(fitted) - min(fitted)) / 30 AS width FROM v)
SELECT CAST(least(floor((fitted - lo) / width), 29) AS INT) AS bin, count(*) AS "N", round(avg(fitted), 6) AS fitted, round(avg(standardised), 6) AS mean,
  round(stddev_samp(standardised), 6) AS sd FROM v, ends GROUP BY ALL""",
)
def weighted_residual_bins_at(spark, folder):
    """Standardised residuals over fitted values under a given variance function."""
    (fit,) = evaluated(spark, folder, "combined", COMBINED, stratum=None)
    bins = D.binned_residuals(D.with_residuals(model_rows(spark, folder), fit, ONE, "y"), 30)
    return bins.withColumns({c: F.round(c, 6) for c in ("fitted", "mean", "sd")})


# --- leverage ----------------------------------------------------------------

INFLUENCE = ("fitted", "residual", "leverage", "standardised", "cook")


def rounded_influence(rows, fit, response):
    out = D.influence(rows, fit, ONE, response, ["l_orderkey", "l_linenumber"])
    scaled = {"leverage": F.col("leverage") * 1e4, "cook": F.col("cook") * 1e4}
    return out.withColumns(scaled).select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in INFLUENCE])


LEVERAGE = """h AS (SELECT l_orderkey, l_linenumber, w, s2, beta0 + beta1 * x AS fitted, y - (beta0 + beta1 * x) AS residual,
  w * (a11 - 2 * a01 * x + a00 * x * x) / det AS h FROM w, q)"""
INFLUENCE_SQL = """SELECT l_orderkey, l_linenumber, round(fitted, 5) AS fitted, round(residual, 5) AS residual, round(h * 1e4, 5) AS leverage,
  round(residual * sqrt(w / (s2 * (1 - h))), 5) AS standardised, round(residual * residual * w * h / (2 * s2 * (1 - h) * (1 - h)) * 1e4, 5) AS cook FROM h"""


@check("ML19 ML20", with_sql(MODEL_ROWS, *weighted_sql(stratum="''"), LEVERAGE) + INFLUENCE_SQL)
def standardised_residuals(spark, folder):
    """Residuals of least squares over their own standard errors."""
    rows = model_rows(spark, folder)
    return rounded_influence(rows, fit_ols(rows, "y", {"linear": ONE})[0], "y")


@check("ML19 ML20 ML22", with_sql(MODEL_ROWS, *weighted_sql(COMBINED, stratum="''"), LEVERAGE) + INFLUENCE_SQL)
def weighted_influence_at(spark, folder):
    """Leverage, standardised residuals and Cook's distance under a given variance function."""
    (fit,) = evaluated(spark, folder, "combined", COMBINED, stratum=None)
    return rounded_influence(model_rows(spark, folder), fit, "y")


ODDS = """j AS (SELECT rows_.*, 1 / (1 + exp(-(q.b0 + q.b1 * l_quantity))) AS m, h00, h01, h11 FROM rows_ JOIN q USING (one)),
d AS (SELECT *, m * (1 - m) * (h11 - 2 * h01 * l_quantity + h00 * l_quantity * l_quantity) / (h00 * h11 - h01 * h01) AS h,
  sign(returned - m) * sqrt(-2 * (returned * ln(m) + (1 - returned) * ln(1 - m))) AS residual FROM j)
SELECT l_orderkey, l_linenumber, round(m, 5) AS fitted, round(residual, 5) AS residual, round(h * 1e4, 5) AS leverage,
  round(residual / sqrt(1 - h), 5) AS standardised, round((returned - m) * (returned - m) / (m * (1 - m)) * h / (2 * (1 - h) * (1 - h)) * 1e4, 5) AS cook FROM d"""


@check("ML19 ML20 ML14", newton_sql(MODEL_ROWS.replace("SELECT", "SELECT 'all' AS one,", 1), "one") + ", " + ODDS)
def logistic_influence(spark, folder):
    """Deviance residuals of a logistic fit, standardised by leverage."""
    rows = model_rows(spark, folder)
    return rounded_influence(rows, fit_logistic(rows, "returned", {"linear": ONE})[0], "returned")


# --- additive models at given smoothing ---------------------------------------

PENALTY = 5e11
SEGMENT = "c_mktsegment"

#: Natural cubic splines through three knots by stratum: their basis, and the penalised solution in closed form.
SPLINES = """k AS (SELECT {by} AS stratum, min(v) AS k0, quantile_cont(v, 0.5) AS k1, max(v) AS k2, count(*) AS n, avg(y) AS my, regr_syy(y, v) AS syy
  FROM rows_ GROUP BY 1),
c AS (SELECT *, k1 - k0 AS h0, k2 - k1 AS h1, 3 / (k2 - k0) AS u, 1 / (k1 - k0) AS q0, -(1 / (k1 - k0) + 1 / (k2 - k1)) AS q1, 1 / (k2 - k1) AS q2 FROM k),
bent AS (SELECT o_orderkey, y, v, c.*, CASE WHEN v < k1 THEN (pow(v - k0, 3) / h0 - h0 * (v - k0)) / 6 ELSE (pow(k2 - v, 3) / h1 - h1 * (k2 - v)) / 6 END * u AS t
  FROM rows_ JOIN c ON c.stratum = {by}),
b AS (SELECT *, t * q0 + CASE WHEN v < k1 THEN (k1 - v) / h0 ELSE 0 END AS b0, t * q1 + CASE WHEN v < k1 THEN (v - k0) / h0 ELSE (k2 - v) / h1 END AS b1,
  t * q2 + CASE WHEN v < k1 THEN 0 ELSE (v - k1) / h1 END AS b2 FROM bent)"""
SOLVED = f"""m AS (SELECT stratum, any_value(n) AS n, any_value(my) AS my, any_value(syy) AS syy, any_value(u) AS u, any_value(q0) AS q0, any_value(q1) AS q1, any_value(q2) AS q2,
  sum(b0 * b0) + {PENALTY} * any_value(u * q0 * q0) AS m00, sum(b0 * b1) + {PENALTY} * any_value(u * q0 * q1) AS m01, sum(b0 * b2) + {PENALTY} * any_value(u * q0 * q2) AS m02,
  sum(b1 * b1) + {PENALTY} * any_value(u * q1 * q1) AS m11, sum(b1 * b2) + {PENALTY} * any_value(u * q1 * q2) AS m12, sum(b2 * b2) + {PENALTY} * any_value(u * q2 * q2) AS m22,
  sum(b0 * y) AS r0, sum(b1 * y) AS r1, sum(b2 * y) AS r2, sum(y * y) AS yy FROM b GROUP BY stratum),
i AS (SELECT *, m11 * m22 - m12 * m12 AS c00, m02 * m12 - m01 * m22 AS c01, m01 * m12 - m02 * m11 AS c02, m00 * m22 - m02 * m02 AS c11,
  m01 * m02 - m00 * m12 AS c12, m00 * m11 - m01 * m01 AS c22 FROM m),
j AS (SELECT *, m00 * c00 + m01 * c01 + m02 * c02 AS det FROM i),
z AS (SELECT *, (c00 * r0 + c01 * r1 + c02 * r2) / det AS beta0, (c01 * r0 + c11 * r1 + c12 * r2) / det AS beta1, (c02 * r0 + c12 * r1 + c22 * r2) / det AS beta2,
  {PENALTY} * u * (q0 * (c00 * q0 + c01 * q1 + c02 * q2) + q1 * (c01 * q0 + c11 * q1 + c12 * q2) + q2 * (c02 * q0 + c12 * q1 + c22 * q2)) / det AS lost FROM j),
y AS (SELECT *, yy - beta0 * r0 - beta1 * r1 - beta2 * r2 - {PENALTY} * u * pow(q0 * beta0 + q1 * beta1 + q2 * beta2, 2) AS rss,
  beta0 * r0 + beta1 * r1 + beta2 * r2 - n * my * my AS explained, 3 - lost AS edf FROM z),
g AS (SELECT *, rss / (n - edf) AS s2 FROM y)"""


def given_gams(spark, folder):
    """Three knots and a given weight of the curvature, in every segment."""
    return fit_gam(order_rows(spark, folder), "y", ["v"], SEGMENT, factor=None, knots=3, penalty=PENALTY)


@check(
    "ML17",
    with_sql(ORDER_ROWS, SPLINES.format(by="'all'"))
    + "SELECT o_orderkey, round(b0, 7) AS b0, round(b1, 7) AS b1, round(b2, 7) AS b2 FROM b",
)
def gam_basis_columns(spark, folder):
    """The basis of a smooth at every row."""
    rows = order_rows(spark, folder)
    (row,) = quantiles(rows, [], ["v"], {"k0": 0.0, "k1": 0.5, "k2": 1.0}).collect()
    columns = spline_columns(rows, {"v": Spline([row["k0"], row["k1"], row["k2"]])}, ["o_orderkey"])
    return columns.select("o_orderkey", *[F.round(f"`s(v).{i + 1}`", 7).alias(f"b{i}") for i in range(3)])


@check(
    "ML17 ML18 SK4",
    with_sql(ORDER_ROWS, SPLINES.format(by=SEGMENT), SOLVED)
    + """SELECT stratum, term, round(CASE term WHEN '(Intercept)' THEN my WHEN 's(v).1' THEN beta0 - my WHEN 's(v).2' THEN beta1 - my ELSE beta2 - my END, 7) AS estimate
FROM g, (VALUES ('(Intercept)'), ('s(v).1'), ('s(v).2'), ('s(v).3')) t(term)""",
)
def gam_coefficients_at(spark, folder):
    """Intercept and values at the knots of the smooth at a given penalty."""
    basis = report.gam_tables(spark, given_gams(spark, folder))[2]
    return basis.select("stratum", "term", F.round("estimate", 7).alias("estimate"))


@check(
    "ML18 SK4",
    with_sql(ORDER_ROWS, SPLINES.format(by=SEGMENT), SOLVED)
    + """SELECT stratum, CAST(n AS BIGINT) AS n, round(my, 7) AS intercept, round(sqrt(s2 / n), 8) AS intercept_error, round(edf, 7) AS edf, round(2 - lost, 7) AS smooth_edf,
  round(2 - lost * lost, 7) AS ref_df, round(explained / (2 * s2), 6) AS f, round(sqrt(s2), 7) AS sigma, round(n * rss / ((n - edf) * (n - edf)), 7) AS gcv,
  round(1 - rss / syy, 7) AS r2 FROM g""",
)
def gam_tables_at(spark, folder):
    """Parametric and smooth tables at a given penalty, with the fit's quality."""
    fits = given_gams(spark, folder)
    parametric, smooth, _ = report.gam_tables(spark, fits)
    quality = spark.createDataFrame([(g.stratum, g.n, *map(float, (g.edf, g.sigma2**0.5, g.gcv, g.r2))) for g in fits], "stratum string, n bigint, edf double, sigma double, gcv double, r2 double")
    intercept = parametric.select("stratum", F.col("estimate").alias("intercept"), F.col("std_error").alias("intercept_error"))
    table = quality.join(intercept, "stratum").join(smooth.select("stratum", F.col("edf").alias("smooth_edf"), "ref_df", "f"), "stratum")
    digits = {"intercept": 7, "intercept_error": 8, "edf": 7, "smooth_edf": 7, "ref_df": 7, "f": 6, "sigma": 7, "gcv": 7, "r2": 7}
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


@check(
    "SK5 ML17",
    with_sql(ORDER_ROWS, SPLINES.format(by=SEGMENT), SOLVED)
    + "SELECT o_orderkey, round(b0 * beta0 + b1 * beta1 + b2 * beta2, 7) AS fitted FROM b JOIN g USING (stratum)",
)
def stored_additive_models(spark, folder):
    """Additive models written to storage, loaded again, and predicted from."""
    path = new_folder(spark, "gams")
    report.save_gams(spark, given_gams(spark, folder), path, "y")
    rows = predict_gam(order_rows(spark, folder), report.load_gams(spark, path, "y"), SEGMENT)
    return rows.select("o_orderkey", F.round("fitted", 7).alias("fitted"))


@check(
    "ML17 ML18",
    with_sql(ORDER_ROWS, f"""f AS (SELECT {SEGMENT} AS stratum, count(*) AS n, regr_slope(y, v) AS b1, regr_intercept(y, v) AS b0, regr_r2(y, v) AS r2,
  (regr_syy(y, v) - regr_slope(y, v) * regr_sxy(y, v)) / (count(*) - 2) AS s2, min(v) AS low FROM rows_ GROUP BY 1)""")
    + "SELECT stratum, round(b0 + b1 * low, 5) AS at_first, round(b1 * 1e4, 5) AS slope, round(r2, 6) AS r2, round(sqrt(s2), 5) AS sigma, 2.0::DOUBLE AS edf FROM f",
)
def gam_linear_limit(spark, folder):
    """With ever more smoothing an additive model becomes least squares on the driver."""
    fits = fit_gam(order_rows(spark, folder), "y", ["v"], SEGMENT, factor=None, log_lambda=20.0)
    rows = []
    for g in fits:
        knots, values = g.splines["v"].knots, g.at_knots("v")
        slope = (values[-1] - values[0]) / (knots[-1] - knots[0])
        rows.append((g.stratum, float(g.estimates()["(Intercept)"] + values[0]), float(slope * 1e4), float(g.r2), float(g.sigma2**0.5), float(g.edf)))
    digits = {"at_first": 5, "slope": 5, "r2": 6, "sigma": 5, "edf": 3}
    table = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{c} double" for c in digits))
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


@check(
    "ML17",
    with_sql(ORDER_ROWS)
    + f"""SELECT {SEGMENT} AS stratum, count(*) AS n, unnest(['(Intercept)', {', '.join(f"'s(v).{i + 1}'" for i in range(10))}]) AS term, 0.0::DOUBLE AS score
FROM rows_ GROUP BY {SEGMENT}""",
)
def gam_score_is_zero(spark, folder):
    """What least squares with the chosen smoothing must make zero, measured on the rows."""
    rows = order_rows(spark, folder)
    parts = []
    for g in fit_gam(rows, "y", ["v"], SEGMENT, factor=None):
        spline, values = g.splines["v"], np.array(g.at_knots("v"))
        pull = g.penalties["v"] * spline.penalty @ values
        mine = predict_gam(rows.where(F.col(SEGMENT) == g.stratum), [g])
        with_basis = spline_columns(mine, {"v": spline}, ["y", "fitted"])
        rest = F.col("y") - F.col("fitted")
        scores = [F.struct(F.lit("(Intercept)").alias("term"), F.avg(rest).alias("score"))]
        for i, p in enumerate(pull):
            name = f"s(v).{i + 1}"
            scores.append(F.struct(F.lit(name).alias("term"), ((F.sum(rest * F.col(f"`{name}`")) - float(p)) / F.count(F.lit(1))).alias("score")))
        found = with_basis.agg(F.count(F.lit(1)).alias("n"), F.array(*scores).alias("scores"))
        parts.append(found.select(F.lit(g.stratum).alias("stratum"), "n", F.explode("scores").alias("s")).select("stratum", "n", "s.term", F.abs(F.round("s.score", 7)).alias("score")))
    return reduce(DataFrame.unionByName, parts)


# --- refit with selection ------------------------------------------------------


@check(
    "ML21 ML5 PF24",
    f"""WITH {ORDER_FIT}, kept AS (SELECT * FROM k ORDER BY k.cook DESC, o_orderkey OFFSET 25),
a AS (SELECT count(*) AS n, regr_intercept(y, v) AS b0, regr_slope(y, v) AS b1, regr_syy(y, v) AS syy, regr_syy(y, v) - regr_slope(y, v) * regr_sxy(y, v) AS rss, avg(y) AS my FROM kept),
p AS (SELECT *, n * ln(rss / n) + 4 AS full_, n * ln(syy / n) + 2 AS less FROM a)
SELECT n, round(full_, 4) AS aic_full, round(least(full_, less), 4) AS aic_final, full_ <= less AS keeps_driver,
  round(CASE WHEN full_ <= less THEN b0 ELSE my END, 6) AS intercept, round(CASE WHEN full_ <= less THEN b1 * 1000 ELSE 0 END, 8) AS slope FROM p""",
)
def refit_with_selection(spark, folder):
    """The most influential rows are taken out of the sums and the model is selected anew, without reading the rest."""
    rows = order_rows(spark, folder)
    moments = cross_products(rows, "y", [V])
    top = D.most_influential(D.influence(rows, ols_of(moments, "", V), V, "y", ["o_orderkey"]), ["o_orderkey"], 25)
    gone = rows.join(materialise(top.select("o_orderkey"), "outliers"), "o_orderkey", "left_semi")
    fit, path = step_backward(moments.without(gone, "y"), "", V)
    slope = dict(zip(fit.names, fit.beta)).get("v", 0.0)
    table = spark.createDataFrame(
        [(fit.n, float(path[0][1]), float(path[-1][1]), "v" in fit.names, float(fit.beta[0]), float(slope * 1000))],
        "n bigint, aic_full double, aic_final double, keeps_driver boolean, intercept double, slope double",
    )
    return table.withColumns({"aic_full": F.round("aic_full", 4), "aic_final": F.round("aic_final", 4), "intercept": F.round("intercept", 6), "slope": F.round("slope", 8)})
