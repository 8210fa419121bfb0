"""Polygons to grid cells: the cell centre decides, later polygons win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import GLOBAL, Grid, with_centres


def rasterize(polygons: DataFrame, attribute: str, grid: Grid = GLOBAL) -> DataFrame:
    """Cells whose centre lies in a polygon, with that polygon's attribute.

    ``polygons`` has one row per ring: ``feature`` (bigint, its order), the
    attribute, and ``ring`` (array of x, y structs, open or closed). Rings of
    one feature combine by the even-odd rule, so holes work.

    Scanline form: each edge lists the grid rows it crosses, the crossings of
    a (feature, row) are paired in x order, and each pair lists the columns
    between. Work grows with boundary plus covered cells, never with cells x
    vertices, and a large feature is spread over its rows.
    """
    edges = polygons.select(
        "feature",
        attribute,
        F.explode(
            F.arrays_zip(
                F.col("ring").alias("a"),
                F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("b"),
            )
        ).alias("e"),
    ).select(
        "feature",
        attribute,
        F.col("e.a.x").alias("x1"),
        F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"),
        F.col("e.b.y").alias("y2"),
    ).where("y1 <> y2")

    lo = F.floor((F.lit(grid.ymax) - F.greatest("y1", "y2")) / grid.yres - 0.5)
    hi = F.ceil((F.lit(grid.ymax) - F.least("y1", "y2")) / grid.yres - 0.5)
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(grid.nrow - 1))
    cy = grid.y("row")
    crossings = (
        edges.where(lo <= hi)
        .select("*", F.explode(F.sequence(lo, hi)).alias("row"))
        .where((F.col("y1") <= cy) != (F.col("y2") <= cy))
        .select(
            "feature",
            attribute,
            F.col("row").cast("int").alias("row"),
            (F.col("x1") + (cy - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("xc"),
        )
    )
    along = Window.partitionBy("feature", "row").orderBy("xc")
    spans = (
        crossings.select(
            "*", F.lead("xc").over(along).alias("xd"), F.row_number().over(along).alias("rank")
        )
        .where("rank % 2 = 1")
    )
    first = F.greatest(F.floor((F.col("xc") - grid.xmin) / grid.xres - 0.5), F.lit(0))
    last = F.least(F.ceil((F.col("xd") - grid.xmin) / grid.xres - 0.5), F.lit(grid.ncol - 1))
    cx = grid.x("col")
    covered = (
        spans.where(first <= last)
        .select("feature", attribute, "row", "xc", "xd", F.explode(F.sequence(first, last)).alias("col"))
        .where((F.col("xc") <= cx) & (cx < F.col("xd")))
    )
    cells = covered.groupBy(F.col("col").cast("int").alias("col"), "row").agg(
        F.max_by(attribute, "feature").alias(attribute)
    )
    return with_centres(cells, grid)
