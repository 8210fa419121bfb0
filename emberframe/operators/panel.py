"""Row and column operators of the panel table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_KEY = ["col", "row", "Year", "Month"]
YEAR_KEY = ["col", "row", "Year"]
CELL_KEY = ["col", "row"]


def join_monthly(panel: DataFrame, layer: DataFrame) -> DataFrame:
    """Left join on cell and month. Duplicate keys multiply rows."""
    return panel.join(_plain(layer), MONTH_KEY, "left")


def join_yearly(panel: DataFrame, layer: DataFrame) -> DataFrame:
    """Left join on cell and year: a yearly value serves all its months."""
    return panel.join(_plain(layer), YEAR_KEY, "left")


def join_static(panel: DataFrame, layer: DataFrame) -> DataFrame:
    """Left join on the cell alone. Left to the planner, which knows the size."""
    return panel.join(_plain(layer), CELL_KEY, "left")


def _plain(layer: DataFrame) -> DataFrame:
    return layer.drop("x", "y")


def keep_known(panel: DataFrame, layer: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Join a driver and drop rows without it, as one inner join."""
    return panel.join(_plain(layer).dropna(subset=[value]), list(key), "inner")


def lookup(df: DataFrame, dimension: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Attach a code table (regions, biomes, continents).

    No hint: the planner broadcasts it while its known size is small, and
    splits a hot code as a skewed join beyond that.
    """
    named = dimension if other is None else dimension.withColumnRenamed(other, on)
    return df.join(named, on, "left")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with anything missing, null or NaN, in any column."""
    return df.dropna("any")


def drop_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where every one of ``columns`` is missing."""
    return df.dropna("all", subset=list(columns))


def fill_zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def fill_category(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(label)))


def row_sum(*columns: str) -> Column:
    """Sum over columns with missing as 0, so all missing gives 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    return total


def fire_presence(df: DataFrame) -> DataFrame:
    """Rows with fire in all three of size, ignitions and duration."""
    return df.where("Size <> 0 AND Ignitions <> 0 AND Duration <> 0")


def small_fire_presence(df: DataFrame) -> DataFrame:
    return df.where("BurnedFraction <> 0 AND Emissions <> 0")


def stratum(df: DataFrame, biome: int | None = None, without_year: int | None = 2016) -> DataFrame:
    """One biome (or all), without the year of incomplete data."""
    out = df if biome is None else df.where(F.col("Biomes") == biome)
    return out if without_year is None else out.where(F.col("Year") != without_year)


def not_bare(df: DataFrame) -> DataFrame:
    return df.where("LC_Bare <> 1")


def binary_response(df: DataFrame, source: str = "Size", name: str = "Fire") -> DataFrame:
    """1 where the response is above zero, else its own value (0)."""
    return df.withColumn(source, F.when(F.col(source) > 0, 1.0).otherwise(F.col(source))).withColumnRenamed(source, name)


def relabel(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rename the sorted levels of a category by position.

    The number of levels must match, so a stratum with one level fails here.
    """
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(len(labels) + 1).collect())
    if len(levels) != len(labels):
        raise ValueError(f"{column} has levels {levels}, expected {len(labels)}")
    renamed = F.when(F.col(column) == levels[0], labels[0])
    for old, new in zip(levels[1:], labels[1:]):
        renamed = renamed.when(F.col(column) == old, new)
    return df.withColumn(column, renamed)


def without_rows(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Remove rows by their key."""
    return df.join(rows.select(*key), list(key), "left_anti")
