"""Array-valued inputs to long rows.

A slab table has one row per time layer with ``values`` as [lon][lat]; a month
matrix has one row per month with ``values`` as [row][col].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import GLOBAL, Grid, flip_rows, regrid_nearest, with_centres


def slab_points(slabs: DataFrame, fill: float | Column | None = None, flip_y: int | None = None) -> DataFrame:
    """(layer, col, row, value): the slab turned to grid orientation.

    The first array dimension is longitude, so it becomes the column. With
    ``flip_y`` (the number of rows) latitudes run south to north in the input.
    Cells equal to ``fill`` are dropped as missing.
    """
    keys = [c for c in slabs.columns if c != "values"]
    rows = (
        slabs.select(*keys, F.posexplode("values").alias("col", "_line"))
        .select(*keys, "col", F.posexplode("_line").alias("row", "value"))
        .withColumn("value", F.col("value").cast("double"))
    )
    if fill is not None:
        rows = rows.withColumn("value", F.nullif(F.col("value"), fill if isinstance(fill, Column) else F.lit(fill)))
    rows = rows.dropna(subset=["value"])
    return rows if flip_y is None else flip_rows(rows, flip_y)


def slab_to_grid(
    slabs: DataFrame, source: Grid, target: Grid = GLOBAL, fill: float | Column | None = None, flip_y: bool = True
) -> DataFrame:
    """Slab layers on the target grid, by nearest cell."""
    points = slab_points(slabs, fill, source.nrow if flip_y else None)
    return regrid_nearest(points, source, target)


def matrix_points(matrices: DataFrame, grid: Grid = GLOBAL) -> DataFrame:
    """(keys..., col, row, x, y, value) from month matrices; zeros stay."""
    keys = [c for c in matrices.columns if c != "values"]
    rows = (
        matrices.select(*keys, F.posexplode("values").alias("row", "_line"))
        .select(*keys, "row", F.posexplode("_line").alias("col", "value"))
        .withColumn("value", F.col("value").cast("double"))
    )
    return with_centres(rows, grid)
