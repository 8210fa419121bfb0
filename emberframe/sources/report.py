"""Model results as tables, and their storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fixed_width
from ..operators.gam import GamFit, Spline
from ..operators.solve import Fit

COEFFICIENTS = "stratum string, label string, kind string, place int, term string, estimate double, std_error double, statistic double, p_value double, converged boolean"
QUALITY = (
    "stratum string, label string, kind string, n bigint, parameters int, sigma double, loglik double, aic double, "
    "df double, converged boolean, passes int, aliased array<string>, extra map<string, double>"
)
SMOOTHS = "stratum string, place int, term string, edf double, ref_df double, f double, p_value double"


def _numbers(row: dict, *names: str) -> list[float]:
    return [float(row[n]) for n in names]


def coefficient_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [
        (f.stratum, f.label, f.kind, i, c["term"], *_numbers(c, "estimate", "std_error", "statistic", "p_value"), f.converged)
        for f in fits
        for i, c in enumerate(f.coefficients())
    ]
    return spark.createDataFrame(rows, COEFFICIENTS)


def quality_table(
    spark: SparkSession, fits: Sequence[Fit], skipped: Mapping[str, tuple[int, str]] | None = None
) -> DataFrame:
    """One row per fit, and one of kind ``skipped`` per stratum left out, labelled by the reason."""
    rows: list[tuple] = [
        (f.stratum, f.label, f.kind, f.n, f.parameters, float(np.sqrt(f.sigma2)), float(f.loglik), float(f.aic),
         float(f.df), f.converged, f.passes, f.aliased, {k: float(v) for k, v in f.extra.items()})
        for f in fits
    ]
    rows += [(s, reason, "skipped", n, *[None] * 9) for s, (n, reason) in (skipped or {}).items()]
    return spark.createDataFrame(rows, QUALITY)


def ranked_by_aic(quality: DataFrame) -> DataFrame:
    """Models of each stratum from best to worst."""
    return quality.orderBy("stratum", "aic", "label")


def printed_coefficients(table: DataFrame, digits: int = 5) -> DataFrame:
    """Coefficients as fixed-width text, ready for a report."""
    numbers = ("estimate", "std_error", "statistic", "p_value")
    return table.withColumns({c: fixed_width(c, digits) for c in numbers})


def ols_report(spark: SparkSession, fit: Fit, call: str, digits: int = 8) -> DataFrame:
    """The least-squares report: call, F test, R-squared lines, then coefficients.

    (line, name, a, b, c, d), all text.
    """
    e = fit.extra

    def number(v: float) -> str:
        return f"{round(v, digits):.{digits}f}"

    # The headings of the report.
    lines = [
        (call, f"F({e['f_df1']:.0f},{e['f_df2']:.0f})", "Prob > P", "R-Squared", "Adj-R2"),
        ("", number(e["f"]), number(e["f_p_value"]), number(e["r2"]), number(e["adjusted_r2"])),
        ("", "", "", "", ""),
        ("", "Estimate", "Std. Error", "t value", "Pr(>|t|)"),
    ]
    lines += [
        (c["term"], *[number(c[k]) for k in ("estimate", "std_error", "statistic", "p_value")])
        for c in fit.coefficients()
    ]
    return spark.createDataFrame(
        [(i, *line) for i, line in enumerate(lines)], "line int, name string, a string, b string, c string, d string"
    )


def gam_tables(spark: SparkSession, fits: Sequence[GamFit]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parametric table, smooth table and basis coefficients."""
    parametric = [
        (g.stratum, "gam", "gam", i, c["term"], *_numbers(c, "estimate", "std_error", "statistic", "p_value"), g.converged)
        for g in fits
        for i, c in enumerate(g.parametric)
    ]
    smooths = [
        (g.stratum, i, s["term"], *_numbers(s, "edf", "ref_df", "f", "p_value")) for g in fits for i, s in enumerate(g.smooths)
    ]
    basis = [(g.stratum, i, c["term"], c["estimate"]) for g in fits for i, c in enumerate(g.coefficients)]
    return (
        spark.createDataFrame(parametric, COEFFICIENTS),
        spark.createDataFrame(smooths, SMOOTHS),
        spark.createDataFrame(basis, "stratum string, place int, term string, estimate double"),
    )


def replace_response(table: DataFrame, folder: str, name: str, response: str, by: Sequence[str]) -> None:
    """Write a table of one response in place of all that was written for it, also in strata that it no longer has."""
    table.write.partitionBy(*by).option("partitionOverwriteMode", "static").mode("overwrite").parquet(f"{folder}/{name}/response={response}")


COVARIANCE = "stratum string, label string, kind string, terms array<string>, covariance array<double>"
EFFECTS = "stratum string, label string, kind string, group_column string, group string, effect double"


def save_fits(spark: SparkSession, fits: Sequence[Fit], folder: str, response: str) -> None:
    """Coefficients, quality, covariance and group effects as Parquet under response, kind, stratum and label.

    Saving a response again replaces all that was saved for it, so a rerun loads once.
    """
    covariance = [(f.stratum, f.label, f.kind, f.names, [float(v) for v in np.ravel(f.covariance)]) for f in fits]
    effects = [(f.stratum, f.label, f.kind, f.group, g, e) for f in fits for g, e in f.effects.items()]
    tables = {
        "coefficients": coefficient_table(spark, fits),
        "quality": quality_table(spark, fits),
        "covariance": spark.createDataFrame(covariance, COVARIANCE),
        "effects": spark.createDataFrame(effects, EFFECTS),
    }
    for name, table in tables.items():
        replace_response(table, folder, name, response, ("kind", "stratum", "label"))


def _saved(spark: SparkSession, folder: str, name: str, response: str, schema: str) -> list:
    """Rows of one small table of fits."""
    table = spark.read.schema(schema).parquet(f"{folder}/{name}/response={response}")
    return table.collect()


def load_fits(spark: SparkSession, folder: str, response: str) -> list[Fit]:
    """Fits written by :func:`save_fits`."""
    key = lambda r: (r["stratum"] or "", r["kind"], r["label"])
    betas: dict[tuple, list] = {}
    for r in _saved(spark, folder, "coefficients", response, COEFFICIENTS):
        betas.setdefault(key(r), []).append(r)
    effects: dict[tuple, list] = {}
    for r in _saved(spark, folder, "effects", response, EFFECTS):
        effects.setdefault(key(r), []).append(r)
    covariances = {key(r): r for r in _saved(spark, folder, "covariance", response, COVARIANCE)}
    fits = []
    for r in _saved(spark, folder, "quality", response, QUALITY):
        c = covariances[key(r)]
        p = len(c["terms"])
        ordered = sorted(betas[key(r)], key=lambda b: b["place"])
        if len(ordered) != p:
            raise ValueError(f"{key(r)}: {len(ordered)} coefficients for {p} terms")
        groups = sorted(effects.get(key(r), []), key=lambda e: e["group"])
        fits.append(
            Fit(
                r["label"], r["stratum"] or "", r["kind"], c["terms"], np.array([b["estimate"] for b in ordered]),
                np.array(c["covariance"]).reshape(p, p), r["n"], r["sigma"] ** 2, r["loglik"], r["parameters"],
                statistic="z" if r["kind"] == "logistic" else "t", df=r["df"], aliased=r["aliased"], extra=r["extra"],
                converged=r["converged"], passes=r["passes"], group=groups[0]["group_column"] if groups else None,
                effects={e["group"]: e["effect"] for e in groups},
            )
        )
    return fits


GAM_QUALITY = "stratum string, n bigint, sigma2 double, gcv double, edf double, r2 double, factor string, converged boolean"
GAM_TERMS = "stratum string, place int, term string, estimate double"
GAM_KNOTS = "stratum string, driver string, smooth int, place int, knot double, penalty double"


def save_gams(spark: SparkSession, fits: Sequence[GamFit], folder: str, response: str) -> None:
    """Additive models as Parquet: quality, both tables, coefficients, knots with penalties, covariance.

    Saving a response again replaces all that was saved for it.
    """
    parametric, smooth, basis = gam_tables(spark, fits)
    quality = [(g.stratum, g.n, *map(float, (g.sigma2, g.gcv, g.edf, g.r2)), g.factor, g.converged) for g in fits]
    knots = [
        (g.stratum, d, i, j, float(k), float(g.penalties[d]))
        for g in fits
        for i, (d, s) in enumerate(g.splines.items())
        for j, k in enumerate(s.knots)
    ]
    covariance = [(g.stratum, [float(v) for v in np.ravel(g.covariance)]) for g in fits]
    tables = {
        "gam_quality": spark.createDataFrame(quality, GAM_QUALITY),
        "gam_parametric": parametric,
        "gam_smooth": smooth,
        "gam_basis": basis,
        "gam_knots": spark.createDataFrame(knots, GAM_KNOTS),
        "gam_covariance": spark.createDataFrame(covariance, "stratum string, covariance array<double>"),
    }
    for name, table in tables.items():
        replace_response(table, folder, name, response, ("stratum",))


def load_gams(spark: SparkSession, folder: str, response: str) -> list[GamFit]:
    """Additive models written by :func:`save_gams`; they predict as the saved ones."""

    def by_stratum(name: str, schema: str, *order: str) -> dict[str, list]:
        out: dict[str, list] = {}
        for r in sorted(_saved(spark, folder, name, response, schema), key=lambda r: tuple(r[o] for o in order)):
            out.setdefault(r["stratum"] or "", []).append(r)
        return out

    numbers = ("estimate", "std_error", "statistic", "p_value")
    parametric = by_stratum("gam_parametric", COEFFICIENTS, "place")
    smooth = by_stratum("gam_smooth", SMOOTHS, "place")
    basis = by_stratum("gam_basis", GAM_TERMS, "place")
    knots = by_stratum("gam_knots", GAM_KNOTS, "smooth", "place")
    covariance = by_stratum("gam_covariance", "stratum string, covariance array<double>")
    fits = []
    for s, (q,) in sorted(by_stratum("gam_quality", GAM_QUALITY).items()):
        by_driver: dict[str, list[float]] = {}
        for k in knots[s]:
            by_driver.setdefault(k["driver"], []).append(k["knot"])
        coefficients = [{"term": r["term"], "estimate": r["estimate"]} for r in basis[s]]
        fits.append(
            GamFit(
                s, q["n"], q["sigma2"], q["gcv"], q["edf"], q["r2"],
                [{"term": r["term"], **{c: r[c] for c in numbers}} for r in parametric[s]],
                [{c: r[c] for c in ("term", "edf", "ref_df", "f", "p_value")} for r in smooth[s]],
                coefficients, {d: Spline(v) for d, v in by_driver.items()}, {k["driver"]: k["penalty"] for k in knots[s]},
                np.array(covariance[s][0]["covariance"]).reshape(len(coefficients), len(coefficients)), q["factor"], q["converged"],
            )
        )
    return fits
