"""Regression models on line items and orders, and the batch over strata."""

from pyspark.sql import functions as F

from emberframe.lineage import materialise, new_folder
from emberframe.operators import diagnose as D
from emberframe.operators.design import model_matrix, model_terms
from emberframe.operators.gam import fit_gam
from emberframe.operators.logistic import fit_logistic
from emberframe.operators.ols import cross_products, fit_ols, ols_of, step_backward
from emberframe.operators.panel import without_rows
from emberframe.operators.profile import standardise
from emberframe.operators.variance import VarianceModel, fit_variance_models
from emberframe.plans.workflow import run_response
from emberframe.sources import report

from .fixtures import DRIVERS, MODEL_ROWS, ORDER_ROWS, check, model_rows, order_rows, with_sql
from .panels import full_panel

ONE = model_terms(["l_quantity"], factor=None)
NONE = model_terms([], factor=None)
V = model_terms(["v"], factor=None)
LINEAR = model_terms(DRIVERS, (), "open")
QUADRATIC = model_terms(DRIVERS, DRIVERS, "open")


def scaled_rows(spark, folder):
    """Model rows with standardised drivers, written once for the passes to come."""
    return materialise(standardise(model_rows(spark, folder), DRIVERS), "model")


# --- least squares -----------------------------------------------------------

MATRIX = model_terms(["l_quantity", "p_size"], ["p_size"], "open")


@check(
    "ML1 SF6 SF7 PF23",
    with_sql(MODEL_ROWS)
    + """SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", open, l_quantity, p_size, p_size * p_size AS "I(p_size^2)",
  open * l_quantity AS "open:l_quantity", open * p_size AS "open:p_size", open * p_size * p_size AS "open:I(p_size^2)" FROM rows_""",
)
def model_columns(spark, folder):
    """The model matrix: dummy, drivers, squares and their interactions."""
    return model_matrix(model_rows(spark, folder), MATRIX, ["l_orderkey", "l_linenumber"])


CROSS = model_terms(["l_quantity", "l_tax"], ["l_tax"], "open")
CROSS_SQL = [
    "1.0::DOUBLE", "open", "l_quantity", "l_tax", "l_tax * l_tax", "open * l_quantity", "open * l_tax", "open * l_tax * l_tax", "y",
]
CROSS_NAMES = [t.name for t in CROSS] + ["y"]


@check(
    "ML2 ML1",
    with_sql(MODEL_ROWS)
    + f"SELECT p_brand, a, b, round(v, 6) AS mean_product FROM (SELECT p_brand, unnest([{', '.join(repr(a) for i, a in enumerate(CROSS_NAMES) for _ in CROSS_NAMES[i:])}]) AS a, "
    + f"unnest([{', '.join(repr(b) for i in range(len(CROSS_NAMES)) for b in CROSS_NAMES[i:])}]) AS b, unnest(["
    + ", ".join(f"avg(({p}) * ({q}))" for i, p in enumerate(CROSS_SQL) for q in CROSS_SQL[i:])
    + "]) AS v FROM rows_ GROUP BY p_brand)",
)
def cross_product_matrix(spark, folder):
    """Mean products of every pair of model columns, by stratum, from one pass."""
    moments = cross_products(model_rows(spark, folder), "y", [CROSS], "p_brand")
    rows = []
    for s in moments.strata:
        m = moments.of(s, CROSS)
        for i, a in enumerate(CROSS_NAMES):
            rows += [(s, a, b, float(m[i, j] / m[0, 0])) for j, b in enumerate(CROSS_NAMES) if j >= i]
    table = spark.createDataFrame(rows, "p_brand string, a string, b string, mean_product double")
    return table.withColumn("mean_product", F.round("mean_product", 6))


SIMPLE = """f AS (SELECT p_brand, count(*) AS n, regr_intercept(y, l_quantity) AS b0, regr_slope(y, l_quantity) AS b1, avg(l_quantity) AS mx,
  regr_sxx(y, l_quantity) AS sxx, regr_syy(y, l_quantity) AS syy, regr_sxy(y, l_quantity) AS sxy FROM rows_ GROUP BY p_brand),
g AS (SELECT *, syy - b1 * sxy AS rss, (syy - b1 * sxy) / (n - 2) AS s2 FROM f)"""


@check(
    "ML2 ML3 ML4 SK3",
    with_sql(MODEL_ROWS, SIMPLE)
    + """SELECT p_brand, n, round(b0, 6) AS intercept, round(b1, 8) AS slope, round(sqrt(s2 / sxx), 8) AS slope_error,
  round(b1 / sqrt(s2 / sxx), 5) AS t, round(sqrt(s2), 6) AS sigma, round(1 - rss / syy, 8) AS r2,
  round(1 - rss / syy * (n - 1) / (n - 2), 8) AS adjusted_r2, round((syy - rss) / s2, 5) AS f,
  round(n * (ln(2 * pi() * rss / n) + 1) + 6, 4) AS aic FROM g""",
)
def ols_by_brand(spark, folder):
    """One-driver least squares in every stratum, with its summary."""
    fits = fit_ols(model_rows(spark, folder), "y", {"linear": ONE}, "p_brand")
    rows = [
        (f.stratum, f.n, float(f.beta[0]), float(f.beta[1]), float(f.se[1]), float(f.beta[1] / f.se[1]), float(f.sigma2**0.5),
         float(f.extra["r2"]), float(f.extra["adjusted_r2"]), float(f.extra["f"]), float(f.aic))
        for f in fits
    ]
    digits = {"intercept": 6, "slope": 8, "slope_error": 8, "t": 5, "sigma": 6, "r2": 8, "adjusted_r2": 8, "f": 5, "aic": 4}
    table = spark.createDataFrame(rows, "p_brand string, n bigint, " + ", ".join(f"{c} double" for c in digits))
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


@check("ML2 ML3 SK2 SK3")
def ols_report(spark, folder):
    """The printed report of the quadratic model with factor interactions."""
    rows = scaled_rows(spark, folder)
    fit = fit_ols(rows, "y", {"quadratic": QUADRATIC})[0]
    return report.ols_report(spark, fit, "y ~ open * (drivers + squares)")


@check(
    "ML5 ML4",
    with_sql(MODEL_ROWS, SIMPLE)
    + """SELECT p_brand, n * ln(rss / n) + 4 <= n * ln(syy / n) + 2 AS keeps_driver, round(n * ln(rss / n) + 4, 4) AS aic_full,
  round(least(n * ln(rss / n) + 4, n * ln(syy / n) + 2), 4) AS aic_final FROM g""",
)
def backward_step_by_brand(spark, folder):
    """Backward selection of a one-driver model in every stratum."""
    moments = cross_products(model_rows(spark, folder), "y", [ONE], "p_brand")
    rows = []
    for s in moments.strata:
        fit, path = step_backward(moments, s, ONE)
        rows.append((s, "l_quantity" in fit.names, path[0][1], path[-1][1]))
    table = spark.createDataFrame(rows, "p_brand string, keeps_driver boolean, aic_full double, aic_final double")
    return table.withColumns({c: F.round(c, 4) for c in ("aic_full", "aic_final")})


@check("ML5")
def stepwise_path(spark, folder):
    """Terms dropped from the quadratic model, one by one, with the AIC after each."""
    moments = cross_products(scaled_rows(spark, folder), "y", [QUADRATIC])
    _, path = step_backward(moments, "", QUADRATIC)
    return spark.createDataFrame([(i, t, float(a)) for i, (t, a) in enumerate(path)], "step int, dropped string, aic double")


@check(
    "SK2 SF8",
    with_sql(MODEL_ROWS, SIMPLE)
    + """SELECT p_brand AS stratum, t.term, printf('%.5f', round(CASE t.term WHEN 'l_quantity' THEN b1 ELSE b0 END, 5)) AS estimate,
  printf('%.5f', round(CASE t.term WHEN 'l_quantity' THEN sqrt(s2 / sxx) ELSE sqrt(s2 * (1.0 / n + mx * mx / sxx)) END, 5)) AS std_error
FROM g, (VALUES ('(Intercept)'), ('l_quantity')) t(term)""",
)
def written_coefficients(spark, folder):
    """Coefficient table rounded to fixed width, written and read back."""
    fits = fit_ols(model_rows(spark, folder), "y", {"linear": ONE}, "p_brand")
    path = new_folder(spark, "coefficients")
    report.printed_coefficients(report.coefficient_table(spark, fits)).write.partitionBy("stratum").csv(path, header=True)
    return spark.read.csv(path, header=True, schema="label string, kind string, place int, term string, estimate string, std_error string, statistic string, p_value string, converged boolean, stratum string").select(
        "stratum", "term", "estimate", "std_error"
    )


@check(
    "SK5",
    with_sql(MODEL_ROWS, SIMPLE)
    + "SELECT p_brand, n, round(b0, 6) AS intercept, round(b1, 8) AS slope, round(sqrt(s2), 6) AS sigma FROM g",
)
def saved_models(spark, folder):
    """Models written to storage and loaded again."""
    fits = fit_ols(model_rows(spark, folder), "y", {"linear": ONE}, "p_brand")
    path = new_folder(spark, "fits")
    report.save_fits(spark, fits, path, "y")
    rows = [(f.stratum, f.n, float(f.beta[0]), float(f.beta[1]), float(f.sigma2**0.5)) for f in report.load_fits(spark, path, "y")]
    table = spark.createDataFrame(rows, "p_brand string, n bigint, intercept double, slope double, sigma double")
    return table.withColumns({"intercept": F.round("intercept", 6), "slope": F.round("slope", 8), "sigma": F.round("sigma", 6)})


# --- variance functions and random intercepts --------------------------------


@check(
    "ML6 ML4",
    with_sql(MODEL_ROWS, SIMPLE)
    + """SELECT p_brand, round((n - 2) * (ln(2 * pi() * s2) + 1) + ln(n * sxx) + 6, 4) AS aic, round(b1, 8) AS slope FROM g""",
)
def gls_baseline_by_brand(spark, folder):
    """Equal-variance model by restricted likelihood, in every stratum."""
    fits = fit_variance_models(model_rows(spark, folder), "y", {"equal": VarianceModel(ONE)}, "p_brand")
    rows = [(f.stratum, float(f.aic), float(f.beta[1])) for f in fits]
    table = spark.createDataFrame(rows, "p_brand string, aic double, slope double")
    return table.withColumns({"aic": F.round("aic", 4), "slope": F.round("slope", 8)})


def gls_candidates():
    models = {"equal": VarianceModel(QUADRATIC)}
    models |= {f"exp({d})": VarianceModel(QUADRATIC, (d,)) for d in DRIVERS}
    models["exp(l_quantity + l_tax)"] = VarianceModel(QUADRATIC, ("l_quantity", "l_tax"))
    models["exp(l_quantity + l_tax + p_size)"] = VarianceModel(QUADRATIC, ("l_quantity", "l_tax", "p_size"))
    return models


@check("ML6 ML7 ML8 SL3")
def variance_candidates(spark, folder):
    """Every variance structure, ranked by AIC."""
    fits = fit_variance_models(scaled_rows(spark, folder), "y", gls_candidates())
    return report.ranked_by_aic(report.quality_table(spark, fits)).drop("aliased", "extra")


@check("ML9 ML12 ML13")
def mixed_model(spark, folder):
    """Random intercept by nation under a combined variance function."""
    models = {"combined": VarianceModel(QUADRATIC, ("l_quantity", "l_tax"))}
    fits = fit_variance_models(scaled_rows(spark, folder), "y", models, group="s_nationkey")
    return report.coefficient_table(spark, fits)


@check("ML10 ML11 ML13 SL3")
def mixed_model_selection(spark, folder):
    """Reduced fixed parts compared by maximum likelihood, then the best refitted."""
    rows = scaled_rows(spark, folder)
    parts = {"full": QUADRATIC}
    parts["without open:l_tax"] = model_terms(DRIVERS, DRIVERS, "open", ["open:l_tax"])
    parts["without tax squares"] = model_terms(DRIVERS, DRIVERS, "open", ["open:l_tax", "I(l_tax^2)", "open:I(l_tax^2)"])
    by_ml = fit_variance_models(
        rows, "y", {k: VarianceModel(t, ("l_quantity",), reml=False) for k, t in parts.items()}, group="s_nationkey"
    )
    best = min(by_ml, key=lambda f: f.aic).label
    final = fit_variance_models(rows, "y", {f"{best} reml": VarianceModel(parts[best], ("l_quantity",))}, group="s_nationkey")
    return report.ranked_by_aic(report.quality_table(spark, by_ml + final)).drop("aliased", "extra")


@check("ML22")
def weighted_residual_bins(spark, folder):
    """Standardised residuals over fitted values under the fitted variance function."""
    rows = scaled_rows(spark, folder)
    fit = fit_variance_models(rows, "y", {"v": VarianceModel(QUADRATIC, ("l_quantity",))})[0]
    return D.binned_residuals(D.with_residuals(rows, fit, QUADRATIC, "y"), 30)


# --- logistic ----------------------------------------------------------------

NEWTON_STEPS = 7


def newton_sql(rows: str = MODEL_ROWS, by: str = "p_brand") -> str:
    """Logistic regression of ``returned`` on quantity by stratum, step by step."""
    parts = [rows, f"n0 AS (SELECT DISTINCT {by}, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM rows_)"]
    for i in range(NEWTON_STEPS):
        parts.append(
            f"""s{i} AS (SELECT {by}, any_value(b0) AS b0, any_value(b1) AS b1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * l_quantity) AS h01,
  sum(m * (1 - m) * l_quantity * l_quantity) AS h11, sum(returned - m) AS g0, sum((returned - m) * l_quantity) AS g1
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * l_quantity))) AS m FROM rows_ JOIN n{i} USING ({by})) GROUP BY {by}),
n{i + 1} AS (SELECT {by}, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
  b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM s{i})"""
        )
    arc = lambda t: f"(-((1 - 2 * ({t})) * sqrt(1 + pow(1 - 2 * ({t}), 2)) + asinh(1 - 2 * ({t}))) / 4)"
    parts.append(
        f"""q AS (SELECT {by}, count(*) AS n, any_value(b0) AS b0, any_value(b1) AS b1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * l_quantity) AS h01,
  sum(m * (1 - m) * l_quantity * l_quantity) AS h11, -2 * sum(returned * ln(m) + (1 - returned) * ln(1 - m)) AS deviance,
  sum(pow({arc('m')} - {arc('returned')}, 2)) AS far, sum(pow({arc('mean_')} - {arc('returned')}, 2)) AS far0,
  -2 * sum(returned * ln(mean_) + (1 - returned) * ln(1 - mean_)) AS null_deviance
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * l_quantity))) AS m, avg(returned) OVER (PARTITION BY {by}) AS mean_
    FROM rows_ JOIN n{NEWTON_STEPS} USING ({by})) GROUP BY {by})"""
    )
    return with_sql(*parts)


NEWTON = newton_sql()


@check(
    "ML14 ML4",
    NEWTON
    + """SELECT p_brand, n, round(b0, 6) AS intercept, round(b1, 8) AS slope, round(sqrt(h00 / (h00 * h11 - h01 * h01)), 8) AS slope_error,
  round(b1 / sqrt(h00 / (h00 * h11 - h01 * h01)), 5) AS z, round(deviance + 4, 4) AS aic FROM q""",
)
def logistic_by_brand(spark, folder):
    """One-driver logistic regression in every stratum."""
    fits = fit_logistic(model_rows(spark, folder), "returned", {"linear": ONE}, "p_brand")
    rows = [(f.stratum, f.n, float(f.beta[0]), float(f.beta[1]), float(f.se[1]), float(f.beta[1] / f.se[1]), float(f.aic)) for f in fits]
    digits = {"intercept": 6, "slope": 8, "slope_error": 8, "z": 5, "aic": 4}
    table = spark.createDataFrame(rows, "p_brand string, n bigint, " + ", ".join(f"{c} double" for c in digits))
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


@check(
    "ML15 SL3",
    NEWTON
    + """, a AS (SELECT p_brand, 'linear' AS label, deviance + 4 AS aic FROM q UNION ALL SELECT p_brand, 'constant', null_deviance + 2 FROM q)
SELECT p_brand, label, round(aic, 4) AS aic, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY aic, label) AS INT) AS place FROM a""",
)
def logistic_selection(spark, folder):
    """Candidate formulas ranked by AIC in every stratum."""
    fits = fit_logistic(model_rows(spark, folder), "returned", {"linear": ONE, "constant": NONE}, "p_brand")
    ordered = sorted(fits, key=lambda f: (f.stratum, f.aic, f.label))
    seen: dict[str, int] = {}
    rows = []
    for f in ordered:
        seen[f.stratum] = seen.get(f.stratum, 0) + 1
        rows.append((f.stratum, f.label, float(f.aic), seen[f.stratum]))
    return spark.createDataFrame(rows, "p_brand string, label string, aic double, place int").withColumn("aic", F.round("aic", 4))


@check("ML16", NEWTON + "SELECT p_brand, round(1 - far / far0, 8) AS r2 FROM q")
def logistic_r_squared(spark, folder):
    """Variance-function R-squared by stratum."""
    fits = fit_logistic(model_rows(spark, folder), "returned", {"linear": ONE}, "p_brand")
    rows = [(f.stratum, float(f.extra["r2_variance"])) for f in fits]
    return spark.createDataFrame(rows, "p_brand string, r2 double").withColumn("r2", F.round("r2", 8))


@check("ML14 ML15 SK2")
def logistic_quadratic(spark, folder):
    """Linear, quadratic and reduced logistic models with all drivers."""
    formulas = {
        "linear": LINEAR,
        "quadratic": QUADRATIC,
        "reduced": model_terms(DRIVERS, DRIVERS, "open", ["open:l_tax", "open:I(p_size^2)"]),
    }
    return report.coefficient_table(spark, fit_logistic(scaled_rows(spark, folder), "returned", formulas))


# --- additive models ---------------------------------------------------------


@check("ML17 ML18 SK4")
def gam_smooth_table(spark, folder):
    """Effective degrees of freedom, F and p of each smooth, by line status."""
    fits = fit_gam(scaled_rows(spark, folder), "y", DRIVERS, factor="open")
    return report.gam_tables(spark, fits)[1]


@check("ML17 ML18 SK4")
def gam_coefficients(spark, folder):
    """Parametric and basis coefficients of the additive model in every segment."""
    rows = order_rows(spark, folder).withColumn("late", (F.col("o_orderstatus") == "F").cast("double"))
    parametric, _, basis = report.gam_tables(spark, fit_gam(rows, "y", ["v"], "c_mktsegment", factor="late"))
    return basis.select("stratum", "term", "estimate").unionByName(parametric.select("stratum", "term", "estimate"))


# --- diagnostics -------------------------------------------------------------

ORDER_FIT = f"""{ORDER_ROWS}, f AS (SELECT count(*) AS n, regr_intercept(y, v) AS b0, regr_slope(y, v) AS b1, regr_sxx(y, v) AS sxx,
  avg(v) AS mv, (regr_syy(y, v) - regr_slope(y, v) * regr_sxy(y, v)) / (count(*) - 2) AS s2 FROM rows_),
r AS (SELECT o_orderkey, y, v, n, s2, b0 + b1 * v AS fitted, y - (b0 + b1 * v) AS residual, 1.0 / n + (v - mv) * (v - mv) / sxx AS h FROM rows_, f),
k AS (SELECT *, residual * residual * h / (2 * s2 * (1 - h) * (1 - h)) AS cook FROM r)"""


def order_fit(rows):
    return ols_of(cross_products(rows, "y", [V]), "", V)


@check(
    "ML19",
    f"WITH {ORDER_FIT} SELECT o_orderkey, round(fitted, 6) AS fitted, round(residual, 6) AS residual, round(residual / sqrt(s2), 6) AS standardised FROM r",
)
def residuals(spark, folder):
    rows = order_rows(spark, folder)
    out = D.with_residuals(rows, order_fit(rows), V, "y")
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("fitted", "residual", "standardised")])


@check(
    "ML19 AG12",
    f"""WITH {ORDER_FIT}, e AS (SELECT min(fitted) AS lo, (max(fitted) - min(fitted)) / 20 AS w FROM r)
SELECT CAST(least(floor((fitted - lo) / w), 19) AS INT) AS bin, count(*) AS "N", round(avg(fitted), 6) AS fitted,
  round(avg(residual / sqrt(s2)), 6) AS mean, round(stddev_samp(residual / sqrt(s2)), 6) AS sd FROM r, e GROUP BY ALL""",
)
def residual_bins(spark, folder):
    rows = order_rows(spark, folder)
    bins = D.binned_residuals(D.with_residuals(rows, order_fit(rows), V, "y"), 20)
    return bins.withColumns({c: F.round(c, 6) for c in ("fitted", "mean", "sd")})


@check(
    "ML20",
    f"WITH {ORDER_FIT} SELECT o_orderkey, round(h * 1e4, 6) AS leverage, round(cook * 1e4, 6) AS cook FROM k",
)
def cooks_distance(spark, folder):
    rows = order_rows(spark, folder)
    out = D.influence(rows, order_fit(rows), V, "y", ["o_orderkey"])
    return out.select("o_orderkey", F.round(F.col("leverage") * 1e4, 6).alias("leverage"), F.round(F.col("cook") * 1e4, 6).alias("cook"))


@check(
    "ML20 SL2",
    f"WITH {ORDER_FIT} SELECT o_orderkey, round(cook * 1e4, 6) AS cook FROM k ORDER BY k.cook DESC, o_orderkey LIMIT 3",
)
def top_influential(spark, folder):
    rows = order_rows(spark, folder)
    top = D.most_influential(D.influence(rows, order_fit(rows), V, "y", ["o_orderkey"]), ["o_orderkey"])
    return top.select("o_orderkey", F.round(F.col("cook") * 1e4, 6).alias("cook"))


@check(
    "ML21 PF24",
    f"""WITH {ORDER_FIT}, kept AS (SELECT * FROM k ORDER BY k.cook DESC, o_orderkey OFFSET 3)
SELECT count(*) AS n, round(regr_intercept(y, v), 6) AS intercept, round(regr_slope(y, v) * 1000, 8) AS slope FROM kept""",
)
def refit_without_outliers(spark, folder):
    """The three most influential rows are removed by key and the model refitted."""
    rows = order_rows(spark, folder)
    top = D.most_influential(D.influence(rows, order_fit(rows), V, "y", ["o_orderkey"]), ["o_orderkey"])
    fit = order_fit(without_rows(rows, top, ["o_orderkey"]))
    table = spark.createDataFrame([(fit.n, float(fit.beta[0]), float(fit.beta[1] * 1000))], "n bigint, intercept double, slope double")
    return table.withColumns({"intercept": F.round("intercept", 6), "slope": F.round("slope", 8)})


@check(
    "ML23",
    f"WITH {MODEL_ROWS} "
    + " UNION ALL ".join(
        f"""SELECT '{d}' AS variable, CAST(len(list_filter(e, lambda q: q < {d})) AS INT) AS bin, count(*) AS "N",
  round(avg({d}), 6) AS driver_mean, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd
  FROM rows_, (SELECT quantile_cont({d}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rows_) GROUP BY ALL"""
        for d in ("l_quantity", "p_retailprice", "s_acctbal")
    ),
)
def driver_profiles(spark, folder):
    """Response over quantile bins of each driver."""
    drivers = ["l_quantity", "p_retailprice", "s_acctbal"]
    rows = materialise(model_rows(spark, folder).select("y", *drivers), "profile-rows")
    table = D.driver_profile(rows, "y", drivers, 10)
    return table.withColumns({c: F.round(c, 6) for c in ("driver_mean", "mean", "sd")})


# --- batch over strata -------------------------------------------------------


@check("ML24 ML2 ML5 ML7 ML8 ML9 ML10 ML11 ML12 ML13 ML17")
def duration_models(spark, folder):
    """Every model of fire duration in every biome."""
    panel = materialise(full_panel(spark, folder), "panel")
    results = run_response(panel, "Duration")
    return report.quality_table(spark, results.fits, results.skipped).drop("aliased", "extra")


@check("ML24 ML14 ML15 ML16")
def presence_models(spark, folder):
    """Every model of fire presence in every biome."""
    panel = materialise(full_panel(spark, folder), "panel")
    results = run_response(panel, "Fire", gam=False)
    return report.coefficient_table(spark, results.fits)
