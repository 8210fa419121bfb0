"""Residuals, influence and binned views of fitted models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import join_groups, materialise
from .design import Term
from .profile import histogram
from .ranks import quantiles
from .solve import Fit
from .sums import key_text


def linear_predictor(fit: Fit, terms: Sequence[Term]) -> Column:
    """Sum of coefficient times term; aliased terms count nothing."""
    by_name = {t.name: t for t in terms}
    total = F.lit(0.0)
    for name, b in zip(fit.names, fit.beta):
        total = total + by_name[name].column() * F.lit(float(b))
    return total


def log_spread(fit: Fit) -> Column:
    """Log of a row's residual standard deviation over sigma, by the fit's variance function."""
    power = F.lit(0.0)
    for name, value in fit.extra.items():
        if name.startswith("delta_"):
            power = power + F.col(name[len("delta_"):]) * F.lit(value)
    return power


def with_residuals(df: DataFrame, fit: Fit, terms: Sequence[Term], response: str, by_group: bool = True) -> DataFrame:
    """Adds fitted, residual and standardised.

    A logistic fit has fitted probabilities and deviance residuals. Under a
    variance function the residual is divided by its own standard deviation.
    Fitted values of a mixed model include the predicted intercept of the row's
    group, or with ``by_group=False`` the fixed part alone; a group that was not
    in the data has intercept 0.
    """
    eta = linear_predictor(fit, terms)
    y = F.col(response)
    if fit.kind == "logistic":
        out = df.withColumn("fitted", 1 / (1 + F.exp(-eta)))
        loss = -2 * F.when(y > 0.5, F.log("fitted")).otherwise(F.log1p(-F.col("fitted")))
        return out.withColumn("residual", F.sqrt(loss) * F.signum(y - F.col("fitted"))).withColumn(
            "standardised", F.col("residual")
        )
    if fit.kind.startswith("lme") and by_group:
        if not fit.effects:
            raise ValueError(f"{fit.label}: no group effects are kept with this fit")
        # one row per group, from the driver; the planner sees its size
        effects = df.sparkSession.createDataFrame(list(fit.effects.items()), "_group string, _effect double")
        df = df.join(effects, key_text(fit.group) == F.col("_group"), "left").drop("_group")
        eta = eta + F.coalesce("_effect", F.lit(0.0))
    spread = F.lit(float(np.sqrt(fit.sigma2)))
    return (
        df.withColumn("fitted", eta)
        .withColumn("residual", y - F.col("fitted"))
        .withColumn("standardised", F.col("residual") / (spread * F.exp(log_spread(fit))))
        .drop("_effect")
    )


def binned_residuals(residuals: DataFrame, bins: int = 50, value: str = "standardised", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, N, fitted, mean, sd): residuals over equal-width bins of the fitted value, by group."""
    ends = residuals.groupBy(*keys).agg(F.min("fitted").alias("_lo"), ((F.max("fitted") - F.min("fitted")) / bins).alias("_width"))
    if keys:
        placed = join_groups(residuals, materialise(ends, "ends"), list(keys))
    else:
        low, width = ends.first()
        placed = residuals.withColumns({"_lo": F.lit(low), "_width": F.lit(width)})
    width = F.when(F.col("_width") > 0, F.col("_width")).otherwise(1.0)
    index = F.least(F.floor((F.col("fitted") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return placed.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("N"),
        F.avg("fitted").alias("fitted"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )


def residual_histogram(residuals: DataFrame, value: str = "residual", keys: Sequence[str] = ()) -> DataFrame:
    return histogram(residuals, [value], keys)


def influence(df: DataFrame, fit: Fit, terms: Sequence[Term], response: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., fitted, residual, leverage, standardised, cook) of a least-squares, weighted or logistic fit.

    Leverage is that of the weighted rows: weights are the inverse of the variance
    function, or the variance of a logistic fit's fitted probability. Standardised
    residuals have unit variance: the residual over its standard deviation and over
    the root of one less the leverage. Residuals of a logistic fit are deviance
    residuals; its Cook's distance is that of Pearson residuals.

    The small inverse travels with the task; the leverage of a row is a
    quadratic form over all terms, so it is computed in NumPy batches.
    """
    if fit.kind.startswith("lme"):
        raise ValueError("leverage of a mixed model depends on its groups; use with_residuals")
    by_name = {t.name: t for t in terms}
    used = [by_name[n] for n in fit.names]
    root = np.linalg.cholesky(fit.covariance / fit.sigma2)
    beta, sigma2, p = fit.beta, fit.sigma2, len(fit.names)
    logistic = fit.kind == "logistic"
    wide = df.select(
        *keep,
        F.col(response).cast("double").alias("_y"),
        log_spread(fit).cast("double").alias("_s"),
        F.array(*[t.column().cast("double") for t in used]).alias("_x"),
    )
    kept = wide.select(*keep).schema
    added = ("fitted", "residual", "leverage", "standardised", "cook")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + [f"{c} double" for c in added])
    names = list(keep)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(len(names) + 2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            y, log_sd = (batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            eta = x @ beta
            if logistic:
                fitted = 1.0 / (1.0 + np.exp(-eta))
                weight = fitted * (1.0 - fitted)
                pearson = (y - fitted) / np.sqrt(weight)
                residual = np.sign(y - fitted) * np.sqrt(2.0 * np.logaddexp(0.0, np.where(y > 0.5, -eta, eta)))
                scaled = residual
            else:
                fitted, weight, residual = eta, np.exp(-2.0 * log_sd), y - eta
                pearson = scaled = residual * np.sqrt(weight)
            h = weight * ((x @ root) ** 2).sum(axis=1)
            standardised = scaled / np.sqrt(sigma2 * (1.0 - h))
            cook = pearson**2 * h / (p * sigma2 * (1.0 - h) ** 2)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(a) for a in (fitted, residual, h, standardised, cook)], names=[*names, *added]
            )

    return wide.mapInArrow(rows, schema)


def most_influential(table: DataFrame, key: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` rows of largest Cook's distance, ties in key order."""
    return table.orderBy(F.desc("cook"), *key).limit(k)


def driver_profile(df: DataFrame, response: str, drivers: Sequence[str], bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Response mean, spread and count over quantile bins of each driver, by group.

    (keys..., variable, bin, N, driver_mean, mean, sd); bins are closed on the right.
    """
    cuts = {f"c{i}": i / bins for i in range(1, bins)}
    group = [*keys, "variable"]
    edges = quantiles(df, keys, drivers, cuts).select(*group, F.array(*cuts).alias("_edges"))
    pairs = F.array(*[F.struct(F.lit(d).alias("variable"), F.col(d).cast("double").alias("v")) for d in drivers])
    long = df.select(*keys, F.col(response).cast("double").alias("_y"), F.explode(pairs).alias("_p")).select(*keys, "_y", "_p.*")
    index = F.size(F.filter("_edges", lambda e: e < F.col("v")))
    return (
        join_groups(long.dropna(subset=["_y", "v"]), materialise(edges, "edges"), group)
        .groupBy(*group, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("N"),
            F.avg("v").alias("driver_mean"),
            F.avg("_y").alias("mean"),
            F.stddev_samp("_y").alias("sd"),
        )
    )
