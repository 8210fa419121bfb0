"""Regular lon/lat grids as long tables keyed by integer cell index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Extent and cell counts; row 0 is the northernmost row."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    ncol: int
    nrow: int

    @property
    def xres(self) -> float:
        return (self.xmax - self.xmin) / self.ncol

    @property
    def yres(self) -> float:
        return (self.ymax - self.ymin) / self.nrow

    def x(self, col: str | Column = "col") -> Column:
        return F.lit(self.xmin) + (_c(col) + 0.5) * self.xres

    def y(self, row: str | Column = "row") -> Column:
        return F.lit(self.ymax) - (_c(row) + 0.5) * self.yres

    def col_of(self, x: str | Column) -> Column:
        """Column holding ``x``; null outside. The right edge belongs to the last column."""
        x = _c(x)
        inside = (x >= self.xmin) & (x <= self.xmax)
        index = F.least(F.floor((x - self.xmin) / self.xres), F.lit(self.ncol - 1))
        return F.when(inside, index).cast("int")

    def row_of(self, y: str | Column) -> Column:
        y = _c(y)
        inside = (y >= self.ymin) & (y <= self.ymax)
        index = F.least(F.floor((F.lit(self.ymax) - y) / self.yres), F.lit(self.nrow - 1))
        return F.when(inside, index).cast("int")


GLOBAL = Grid(-180.0, 180.0, -90.0, 90.0, 1440, 720)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extent_of(lon: Sequence[float], lat: Sequence[float], mode: str = "edges") -> Grid:
    """Grid of a slab with the given cell centres.

    ``edges`` puts the outer borders half a cell beyond the outer centres;
    ``centres`` takes the outer centres themselves as borders, which shrinks
    each cell slightly.
    """
    nx, ny = len(lon), len(lat)
    xlo, xhi, ylo, yhi = min(lon), max(lon), min(lat), max(lat)
    if mode == "edges":
        hx, hy = (xhi - xlo) / (nx - 1) / 2, (yhi - ylo) / (ny - 1) / 2
        return Grid(xlo - hx, xhi + hx, ylo - hy, yhi + hy, nx, ny)
    if mode == "centres":
        return Grid(xlo, xhi, ylo, yhi, nx, ny)
    raise ValueError("mode is 'edges' or 'centres'")


def with_centres(df: DataFrame, grid: Grid = GLOBAL) -> DataFrame:
    return df.withColumn("x", grid.x()).withColumn("y", grid.y())


def grid_cells(spark: SparkSession, grid: Grid = GLOBAL) -> DataFrame:
    """Every cell of the grid with its centre."""
    cells = spark.range(grid.ncol * grid.nrow).select(*cell_of_position("id", grid))
    return with_centres(cells, grid)


def cell_of_position(position: str | Column, grid: Grid = GLOBAL) -> list[Column]:
    """Row-major position to (col, row): how a flat matrix lines up with the grid."""
    p = _c(position).cast("bigint")
    return [
        (p % grid.ncol).cast("int").alias("col"),
        F.floor(p / grid.ncol).cast("int").alias("row"),
    ]


def bind_positions(df: DataFrame, position: str, grid: Grid = GLOBAL) -> DataFrame:
    """Attach cells to values by their place in the flattened matrix."""
    rest = [c for c in df.columns if c != position]
    return with_centres(df.select(*cell_of_position(position, grid), *rest), grid)


def timeline(spark: SparkSession, first_year: int, last_year: int, monthly: bool = True) -> DataFrame:
    """One row per month (or year), with its layer index."""
    per_year = 12 if monthly else 1
    layers = spark.range((last_year - first_year + 1) * per_year).withColumnRenamed("id", "layer")
    return layer_period(layers, first_year, last_year, monthly)


def layer_period(
    df: DataFrame, first_year: int, last_year: int, monthly: bool = True, layer: str = "layer"
) -> DataFrame:
    """Layer index (from 0) to Year and Month; layers past the timeline are dropped."""
    per_year = 12 if monthly else 1
    known = df.where(F.col(layer).between(0, (last_year - first_year + 1) * per_year - 1))
    out = known.withColumn("Year", (F.lit(first_year) + F.floor(F.col(layer) / per_year)).cast("int"))
    return out.withColumn("Month", (F.col(layer) % 12 + 1).cast("int")) if monthly else out


def each_year(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return df.withColumn("Year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))


def each_month(df: DataFrame) -> DataFrame:
    return df.withColumn("Month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def grid_by_timeline(cells: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every cell in every month, without a join: the months are generated per row."""
    return each_month(each_year(cells, first_year, last_year))


def sentinel_to_null(df: DataFrame, column: str, fill: float | Column) -> DataFrame:
    value = fill if isinstance(fill, Column) else F.lit(fill)
    return df.withColumn(column, F.nullif(F.col(column), value))


def drop_empty(df: DataFrame, column: str = "value") -> DataFrame:
    """Keep only cells that hold a value (neither null nor NaN)."""
    return df.dropna(subset=[column])


def flip_rows(df: DataFrame, nrow: int, row: str = "row") -> DataFrame:
    return df.withColumn(row, (F.lit(nrow - 1) - F.col(row)).cast("int"))


def transpose(df: DataFrame) -> DataFrame:
    """Swap the two index columns."""
    rest = [c for c in df.columns if c not in ("col", "row")]
    return df.select(F.col("row").alias("col"), F.col("col").alias("row"), *rest)


def regrid_nearest(df: DataFrame, source: Grid, target: Grid = GLOBAL) -> DataFrame:
    """Value of the source cell that holds each target centre.

    Every source cell lists the target cells whose centres it holds, so the
    step is narrow: no join and no shuffle. Targets outside the source extent
    get no row.
    """

    def targets(index: str, lo: Column, size: float, tmin: Column, tres: float, count: int) -> Column:
        first = F.floor((lo - tmin) / tres - 0.5) - 1
        last = F.ceil((lo + size - tmin) / tres - 0.5) + 1
        span = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(count - 1)))
        some = (first <= count - 1) & (last >= 0)
        return F.explode(F.when(some, span)).alias(index)

    x_lo = F.lit(source.xmin) + F.col("col") * source.xres
    # distances are measured southward from the top edge of each grid
    y_lo = F.col("row") * source.yres
    top = F.lit(source.ymax - target.ymax)
    rest = [c for c in df.columns if c not in ("col", "row", "x", "y")]
    wide = df.select(
        "col", "row", *rest, targets("_tc", x_lo, source.xres, F.lit(target.xmin), target.xres, target.ncol)
    ).select("*", targets("_tr", y_lo, source.yres, top, target.yres, target.nrow))
    hit = (source.col_of(target.x("_tc")) == F.col("col")) & (source.row_of(target.y("_tr")) == F.col("row"))
    return with_centres(
        wide.where(hit).select(
            F.col("_tc").cast("int").alias("col"), F.col("_tr").cast("int").alias("row"), *rest
        ),
        target,
    )


def map_layer(df: DataFrame, value: str, period: Column | None = None) -> DataFrame:
    """One value per cell, the latest of the chosen period."""
    chosen = df if period is None else df.where(period)
    return (
        chosen.groupBy("col", "row")
        .agg(F.max_by(value, F.struct("Year", "Month")).alias(value))
    )
