"""Profiles and screens of the panel: counts, spreads, shapes, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TRANSFORMS
from ..lineage import join_groups, materialise
from ..sources.tables import missing
from .ranks import long_form, order_statistics, quantiles
from .sums import sum_blocks


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return count_by(df, column)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing), all columns in one pass."""
    return _per_column(df, columns or df.columns, lambda c: F.count_if(missing(df, c)), "missing")


def zero_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nonzero, zero), missing values in neither."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c) != 0).alias(f"nz_{c}"), F.count_if(F.col(c) == 0).alias(f"z_{c}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"nz_{c}").alias("nonzero"), F.col(f"z_{c}").alias("zero"))
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def _per_column(df: DataFrame, columns: Sequence[str], agg, name: str) -> DataFrame:
    wide = df.agg(*[agg(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high)."""
    aggs = [a for c in columns for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo_{c}").cast("double").alias("low"),
                F.col(f"hi_{c}").cast("double").alias("high"),
            )
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles (type 7), mean and maximum; exact at any size."""
    return quantiles(df, keys, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


# --- correlation -------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair, a before b; pairwise complete.

    A pair uses the rows where both are known, so each pair has its own counts
    and sums. Columns are centred first, which keeps the sums accurate.
    """
    centres = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in columns]).first()
    centre = np.array([[centres[c] or 0.0] for c in columns])
    k = len(columns)

    def block(key, values):
        known = ~np.isnan(values)
        x = np.where(known, values - centre, 0.0)
        both = known.astype(float)
        sums = [both @ both.T, x @ both.T, (x * x) @ both.T, x @ x.T]
        yield "", np.concatenate([m.ravel() for m in sums])

    total = sum_blocks(df, [], columns, block).get((("",), ""), np.zeros(4 * k * k))
    n, x, xx, xy = total.reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * xy - x * x.T) / np.sqrt((n * xx - x * x) * (n * xx - x * x).T)
    rows = [
        (columns[i], columns[j], float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, j in combinations(range(k), 2)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def collinear_pairs(df: DataFrame, columns: Sequence[str], above: float = 0.7) -> DataFrame:
    """Pairs whose signed correlation exceeds the threshold."""
    return correlation_matrix(df, columns).where(F.col("r") > above)


# --- histograms --------------------------------------------------------------


def round_step(span: Column, bins: Column) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten that cuts ``span`` into about ``bins``.

    The next larger step is taken when it is nearer to the wanted cell size,
    larger steps being favoured by the usual weights 1.5 and 2.75.
    """
    cell = span / bins
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    to_two = (2 * base - cell) < 1.5 * (cell - base)
    to_five = (5 * base - cell) < 2.75 * (cell - 2 * base)
    to_ten = (10 * base - cell) < 1.5 * (cell - 5 * base)
    return (
        F.when(to_two & to_five & to_ten, 10 * base)
        .when(to_two & to_five, 5 * base)
        .when(to_two, 2 * base)
        .otherwise(base)
    )


def _breaks(stats: DataFrame) -> DataFrame:
    wanted = F.ceil(F.log2(F.col("n")) + 1 - 1e-9)
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(
        F.greatest(F.abs("high"), F.lit(1.0))
    )
    stepped = stats.withColumn("step", round_step(span, wanted))
    return stepped.withColumn("start", F.floor(F.col("low") / F.col("step") + 1e-10) * F.col("step"))


def histogram(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., variable, bin, lower, upper, N): round-number bins, right-closed.

    The number of bins follows the size of the group (Sturges).
    """
    values = long_form(df, keys, columns)
    group = [*keys, "variable"]
    stats = values.groupBy(*group).agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return _binned(values, _breaks(stats), group)


def _binned(values: DataFrame, breaks: DataFrame, group: list[str]) -> DataFrame:
    index = F.greatest(F.ceil((F.col("value") - F.col("start")) / F.col("step") - 1e-7), F.lit(1))
    # without keys there is one row of breaks per profiled column
    ends = breaks.select(*group, "start", "step")
    ends = F.broadcast(ends) if group == ["variable"] else materialise(ends, "breaks")
    return (
        join_groups(values, ends, group)
        .groupBy(*group, "start", "step", index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("N"))
        .select(
            *group,
            "bin",
            (F.col("start") + (F.col("bin") - 1) * F.col("step")).alias("lower"),
            (F.col("start") + F.col("bin") * F.col("step")).alias("upper"),
            "N",
        )
    )


def normal_histograms(df: DataFrame, column: str, transforms: Sequence[str]) -> DataFrame:
    """Histograms of several transforms of one column, with the fitted normal.

    (variable, bin, lower, upper, N, mean, sd, expected): ``expected`` is the
    normal count at the middle of the bin.
    """
    shaped = df.select(*[TRANSFORMS[t](column).alias(t) for t in transforms])
    values = long_form(shaped, [], transforms)
    stats = values.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    counts = _binned(values, _breaks(stats), ["variable"])
    middle = (F.col("lower") + F.col("upper")) / 2
    z = (middle - F.col("mean")) / F.col("sd")
    density = F.exp(-0.5 * z * z) / (F.col("sd") * (2 * 3.141592653589793) ** 0.5)
    fitted = stats.select("variable", F.col("n").alias("total"), "mean", "sd")
    return counts.join(F.broadcast(fitted), "variable").select(
        "variable", "bin", "lower", "upper", "N", "mean", "sd",
        (density * F.col("total") * (F.col("upper") - F.col("lower"))).alias("expected"),
    )


# --- box plots ---------------------------------------------------------------


def box_stats(df: DataFrame, value: str, keys: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Hinges, median, whiskers and outlier count per factor combination.

    Hinges are the medians of the halves, not quartiles. Whiskers end at the
    outermost values within ``reach`` times the hinge spread.
    """
    n = F.col("n")
    depth = F.floor((n + 3) / 2) / 2
    ranks: Mapping[str, Column] = {
        "h1a": F.floor(depth),
        "h1b": F.ceil(depth),
        "ma": F.floor((n + 1) / 2),
        "mb": F.ceil((n + 1) / 2),
        "h2a": F.floor(n + 1 - depth),
        "h2b": F.ceil(n + 1 - depth),
    }
    stats = order_statistics(df, keys, [value], ranks).select(
        *keys,
        "n",
        ((F.col("h1a") + F.col("h1b")) / 2).alias("lower_hinge"),
        ((F.col("ma") + F.col("mb")) / 2).alias("median"),
        ((F.col("h2a") + F.col("h2b")) / 2).alias("upper_hinge"),
    )
    spread = reach * (F.col("upper_hinge") - F.col("lower_hinge"))
    fenced = stats.withColumn("_lo", F.col("lower_hinge") - spread).withColumn("_hi", F.col("upper_hinge") + spread)
    fenced = materialise(fenced, "fences")
    v = F.col(value).cast("double")
    inside = v.between(F.col("_lo"), F.col("_hi"))
    return (
        join_groups(df.select(*keys, value).dropna(subset=[value]), fenced, list(keys))
        .groupBy(*keys, "n", "lower_hinge", "median", "upper_hinge")
        .agg(
            F.min(F.when(inside, v)).alias("lower_whisker"),
            F.max(F.when(inside, v)).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )


# --- standardising -----------------------------------------------------------


def standardise(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), constant: float | None = None
) -> DataFrame:
    """(x - mean) / sample sd, within each stratum of ``by``.

    A column that is constant in a stratum fails, or becomes ``constant`` there.
    """
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    if by:
        spreads = materialise(df.groupBy(*by).agg(*aggs), "spreads")
        wide = join_groups(df, spreads, list(by))
    else:
        stats = df.agg(*aggs).first()
        wide = df.select("*", *[F.lit(stats[i]).cast("double").alias(i) for i in stats.asDict()])
    scaled = {
        c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(
            F.raise_error(F.lit(f"{c} is constant")).cast("double") if constant is None else F.lit(constant)
        )
        for c in columns
    }
    return wide.withColumns(scaled).select(*df.columns)
