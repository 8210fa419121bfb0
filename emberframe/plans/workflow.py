"""Screening and fitting all biomes of one response together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import TRANSFORMS, log_plus_one, square_root
from ..lineage import materialise
from ..operators.design import Term, factor_dummy, model_terms
from ..operators.diagnose import binned_residuals, driver_profile, influence, most_influential, residual_histogram, with_residuals
from ..operators.gam import GamFit, fit_gam
from ..operators.logistic import fit_logistic
from ..operators.ols import CrossProducts, collinear, cross_products, ols_of, step_backward
from ..operators.panel import binary_response, drop_incomplete, fire_presence, not_bare, relabel, stratum, without_rows
from ..operators.profile import standardise
from ..operators.solve import Fit
from ..operators.variance import fit_variance_models
from ..sources.report import coefficient_table, gam_tables, ols_report, quality_table, replace_response
from .models import DRIVERS, DUMMY, MODELS, FireModel

SCALED = (*DRIVERS, "LC_Bare")
#: Fits whose residuals and influence belong to the results, by kind and label.
SHOWN = {("ols", "full"), ("ols", "stepwise"), ("gls_reml", "equal"), ("lme_reml", "full reml"), ("lme_reml", "final reml"), ("logistic", "full")}
#: Rows of largest Cook's distance that are listed.
INFLUENTIAL = 5


@dataclass
class Results:
    """Everything fitted for one response, over all its biomes."""

    response: str
    fits: list[Fit] = field(default_factory=list)
    gams: list[GamFit] = field(default_factory=list)
    paths: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    skipped: dict[str, tuple[int, str]] = field(default_factory=dict)  # rows, reason
    collinear: list[tuple[str, str, str, float]] = field(default_factory=list)  # stratum, a, b, r
    removed: DataFrame | None = None  # keys of the rows removed as outliers
    rows: DataFrame | None = None  # what the last fits saw, scaled
    formulas: dict[tuple[str, str], tuple[Term, ...]] = field(default_factory=dict)  # by stratum and label

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Every result as a table; diagnostics are planned here and computed when read."""
        out = {"coefficients": coefficient_table(spark, self.fits), "quality": quality_table(spark, self.fits, self.skipped)}
        out["collinear"] = spark.createDataFrame(self.collinear, "stratum string, a string, b string, r double")
        out["paths"] = spark.createDataFrame(
            [(s, i, t, float(a)) for s, path in self.paths.items() for i, (t, a) in enumerate(path)],
            "stratum string, step int, dropped string, aic double",
        )
        if self.gams:
            out["gam_parametric"], out["gam_smooth"], out["gam_basis"] = gam_tables(spark, self.gams)
        if self.rows is not None:
            out |= self.diagnostics()
        if self.removed is not None:
            out["removed"] = self.removed
        return out

    def diagnostics(self, bins: int = 50) -> dict[str, DataFrame]:
        """Reports, residuals, influence and driver profiles of the models that the workflow looks at."""
        spark = self.rows.sparkSession
        shown = [f for f in self.fits if (f.kind, f.label) in SHOWN]
        out: dict[str, DataFrame] = {}
        reports = [
            ols_report(spark, f, f"{self.response} ~ {f.label}").select(F.lit(f.stratum).alias("stratum"), F.lit(f.label).alias("label"), "*")
            for f in shown
            if f.kind == "ols"
        ]
        if reports:
            out["reports"] = reduce(DataFrame.unionByName, reports)
        named = lambda f: [F.lit(f.stratum).alias("stratum"), F.lit(f"{f.kind} {f.label}").alias("label")]
        key = ["col", "row", "Year", "Month"]
        residuals, influential = [], []
        for f in shown:
            mine, terms = self.rows.where(F.col("Biomes") == int(f.stratum)), self.formulas[f.stratum, f.label]
            residuals.append(with_residuals(mine, f, terms, self.response).select(*named(f), "fitted", "residual", "standardised"))
            if f.kind in ("ols", "logistic"):
                table = influence(mine, f, terms, self.response, key)
                influential.append(most_influential(table, key, INFLUENTIAL).select(*named(f), *key, "residual", "standardised", "leverage", "cook"))
        every = reduce(DataFrame.unionByName, residuals)
        out["residual_bins"] = binned_residuals(every, bins, keys=["stratum", "label"])
        out["residual_histograms"] = residual_histogram(every, keys=["stratum", "label"])
        out["influential"] = reduce(DataFrame.unionByName, influential)
        profiles = driver_profile(self.rows, self.response, [c for c in SCALED if c in DRIVERS], keys=["Biomes"])
        out["driver_profiles"] = profiles.withColumn("stratum", F.col("Biomes").cast("string")).drop("Biomes")
        return out

    def write(self, spark: SparkSession, folder: str) -> None:
        """Parquet under response, stratum and model; writing again replaces all that was written for the response."""
        for name, table in self.tables(spark).items():
            by = ["stratum", *(["label"] if "label" in table.columns else [])]
            replace_response(table, folder, name, self.response, by)


def model_rows(panel: DataFrame, models: Sequence[FireModel], by_factor: str = "IDL_Layer") -> DataFrame:
    """Rows and columns the models of one response need, transformed, not yet scaled."""
    response = models[0].response
    rows = panel if response == "Fire" else fire_presence(panel)
    rows = stratum(not_bare(rows), None).where(F.col("Biomes").isin([m.biome for m in models]))
    if response == "Fire":
        rows = binary_response(rows)
    rows = drop_incomplete(rows.drop("GFED_Regions_Desc", "Biomes_Desc"))
    if response != "Fire":
        shaped = F.when(F.lit(False), F.lit(0.0))
        for m in models:
            shaped = shaped.when(F.col("Biomes") == m.biome, TRANSFORMS[m.transform](response))
        rows = rows.withColumn(response, shaped)
    rows = (
        rows.withColumn("PopDensity_log", log_plus_one("PopDensity"))
        .withColumn("RoadDensity_sqrt", square_root("RoadDensity"))
        .drop("PopDensity", "RoadDensity")
    )
    keep = ["col", "row", "Year", "Month", "Biomes", "GFED_Regions", "Continent", by_factor, response, *SCALED]
    return materialise(rows.select(*keep), "model-rows")


def unfit_strata(rows: DataFrame, models: Sequence[FireModel], by_factor: str = "IDL_Layer") -> dict[str, tuple[int, str]]:
    """Rows and reason of each biome whose model cannot be fitted."""
    measured = rows.groupBy("Biomes").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(by_factor) < F.max(by_factor)).alias("two_levels"),
        *[F.stddev_samp(c).alias(c) for c in SCALED],
    )
    by_biome = {r["Biomes"]: r for r in measured.collect()}  # one row per biome
    out: dict[str, tuple[int, str]] = {}
    for m in models:
        r = by_biome.get(m.biome)
        n = r["n"] if r else 0
        if n <= len(m.full()) + 2:
            out[str(m.biome)] = (n, f"too few rows for {len(m.full())} coefficients")
        elif not r["two_levels"]:
            out[str(m.biome)] = (n, f"{by_factor} has one level")
        elif constant := [c for c in SCALED if c in m.columns() and not r[c] > 0]:
            out[str(m.biome)] = (n, f"{', '.join(constant)} constant")
    return out


def scaled_rows(rows: DataFrame, models: Sequence[FireModel], by_factor: str = "IDL_Layer") -> DataFrame:
    """Rows of the models' biomes, scaled within each; a constant that no formula uses becomes 0.

    Written once, because every later step reads it again. Sorted by biome, so
    that a block of rows seldom falls apart into several strata.
    """
    rows = rows.where(F.col("Biomes").isin([m.biome for m in models]))
    rows = factor_dummy(relabel(rows, by_factor, ("IDL", DUMMY)), by_factor, DUMMY, DUMMY)
    scaled = standardise(rows, SCALED, ["Biomes"], constant=0.0)
    return materialise(scaled.sortWithinPartitions("Biomes"), "model-table")


def model_table(panel: DataFrame, models: Sequence[FireModel], by_factor: str = "IDL_Layer") -> DataFrame:
    """The scaled rows of every biome that can be fitted."""
    rows = model_rows(panel, models, by_factor)
    unfit = unfit_strata(rows, models, by_factor)
    return scaled_rows(rows, [m for m in models if str(m.biome) not in unfit], by_factor)


def run_response(panel: DataFrame, response: str, biomes: Sequence[int] | None = None, gam: bool = True) -> Results:
    """Fit every model of a response in every biome that can be fitted; the others are named in ``skipped``.

    Cross products are read once. Where a model's outliers are to be removed, they
    are taken out of the sums for least squares and out of the rows for the rest.
    """
    results, models, moments = screen_response(panel, response, biomes)
    if not models:
        return results
    if response == "Fire":
        _presence(results.rows, models, results)
    else:
        results.rows, moments = _without_outliers(results.rows, moments, models, results)
        _continuous(results.rows, moments, models, results, gam)
    return results


def screen_response(
    panel: DataFrame, response: str, biomes: Sequence[int] | None = None
) -> tuple[Results, list[FireModel], CrossProducts | None]:
    """What comes before any fit: scaled rows, the models that can be fitted, cross products, collinear pairs."""
    models = [m for m in MODELS if m.response == response and (biomes is None or m.biome in biomes)]
    rows = model_rows(panel, models)
    results = Results(response, skipped=unfit_strata(rows, models))
    fitted = [m for m in models if str(m.biome) not in results.skipped]
    if not fitted:
        return results, [], None
    results.rows = scaled_rows(rows, fitted)
    formulas = [model_terms(DRIVERS, (), DUMMY), *(m.full() for m in fitted)]
    moments = cross_products(results.rows, response, formulas, "Biomes")
    results.collinear = collinear(moments, DRIVERS)
    return results, fitted, moments


def _without_outliers(
    table: DataFrame, moments: CrossProducts, models: Sequence[FireModel], results: Results
) -> tuple[DataFrame, CrossProducts]:
    """Rows and cross products after the most influential rows of the selected models are removed."""
    key = ["col", "row", "Year", "Month", "Biomes"]
    found = []
    for m in models:
        if m.outliers:
            chosen, results.paths[f"{m.biome} with outliers"] = step_backward(moments, str(m.biome), m.full(), "stepwise")
            mine = table.where(F.col("Biomes") == m.biome)
            found.append(most_influential(influence(mine, chosen, m.full(), m.response, key), key, m.outliers).select(*key))
    if not found:
        return table, moments
    removed = materialise(reduce(DataFrame.unionByName, found), "outliers")
    results.removed = removed.withColumn("stratum", F.col("Biomes").cast("string"))
    gone = table.join(removed, key, "left_semi")
    kept = materialise(without_rows(table, removed, key).sortWithinPartitions("Biomes"), "model-table")
    return kept, moments.without(gone, results.response, "Biomes")


def _presence(table: DataFrame, models: Sequence[FireModel], results: Results) -> None:
    formulas, only = {}, {}
    for m in models:
        mine = {"linear": m.linear(), **m.fixed_parts()}
        only[str(m.biome)] = [f"{m.biome} {k}" for k in mine]
        formulas.update({f"{m.biome} {k}": t for k, t in mine.items()})
        results.formulas.update({(str(m.biome), k): t for k, t in mine.items()})
    results.fits += _unprefixed(fit_logistic(table, "Fire", formulas, "Biomes", only))


def _continuous(
    table: DataFrame, moments: CrossProducts, models: Sequence[FireModel], results: Results, gam: bool
) -> None:
    for m in models:
        key = str(m.biome)
        results.fits.append(ols_of(moments, key, m.linear(), "linear"))
        results.fits.append(ols_of(moments, key, m.full(), "full"))
        chosen, results.paths[key] = step_backward(moments, key, m.full(), "stepwise")
        results.fits.append(chosen)
        results.formulas.update({(key, "linear"): m.linear(), (key, "full"): m.full(), (key, "stepwise"): m.full()})
    for kind, group in (("variance_models", None), ("mixed_models", "GFED_Regions")):
        batch, only = {}, {}
        for m in models:
            mine = getattr(m, kind)()
            only[str(m.biome)] = [f"{m.biome} {k}" for k in mine]
            batch.update({f"{m.biome} {k}": v for k, v in mine.items()})
            results.formulas.update({(str(m.biome), k): v.terms for k, v in mine.items()})
        results.fits += _unprefixed(
            fit_variance_models(table, m.response, batch, "Biomes", group=group, only=only)
        )
    if gam:
        results.gams = fit_gam(table, models[0].response, {str(m.biome): m.drivers for m in models}, "Biomes")


def _unprefixed(fits: list[Fit]) -> list[Fit]:
    """Labels carry the biome while formulas of several biomes share a pass."""
    for f in fits:
        f.label = f.label.split(" ", 1)[1]
    return fits
