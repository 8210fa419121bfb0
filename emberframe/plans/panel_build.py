"""The panel: one row per land cell and month, drivers and responses side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import new_folder
from ..operators.grid import GLOBAL, Grid, each_month, each_year, with_centres
from ..operators.panel import (
    CELL_KEY,
    MONTH_KEY,
    YEAR_KEY,
    fill_category,
    fill_zero,
    join_monthly,
    join_static,
    keep_known,
    lookup,
    row_sum,
)
from .codes import INDIGENOUS, NOT_INDIGENOUS, biome_codes, region_codes

# Drivers a row cannot do without, and the order of the panel's columns.
REQUIRED = ("TMax", "DTR", "NrWetDays", "PET", "Precipitation", "RoadDensity", "DistUrbPop")
OPTIONAL = ("LAI", "fPAR")
COVERS = ("LC_Tree", "LC_Shrub", "LC_Crop", "LC_Herbs", "LC_Bare")
FIRES = ("Size", "Duration", "Ignitions")
SMALL_FIRES = ("BurnedFraction", "Emissions")
COLUMNS = (
    ("x", "y", "Year", "Month", "GFED_Regions", "GFED_Regions_Desc")
    + REQUIRED
    + ("PopDensity",)
    + OPTIONAL
    + ("LC_Tree", "LC_Shrub", "LC_Crop", "LC_Herbs")
    + FIRES
    + ("IDL_Layer", "Biomes", "Biomes_Desc", "Continent")
    + SMALL_FIRES
    + ("LC_Bare",)
)


@dataclass
class PanelInputs:
    """Tables keyed by integer cell, plus Year and Month where they vary in time.

    ``regions``: col, row, GFED_Regions. ``monthly`` and ``yearly``: one table
    per driver or response with its value in a column of that name. ``covers``:
    for each cover, its classes as (table, column) to be summed.
    ``indigenous``: cells of indigenous land. ``biomes``: col, row, Biomes.
    ``continents``: col, row, Continent. ``buckets``: into how many buckets by
    cell the monthly and yearly tables are dealt, if they are (see ``bucketed``).
    """

    regions: DataFrame
    monthly: Mapping[str, DataFrame]
    yearly: Mapping[str, DataFrame]
    covers: Mapping[str, Sequence[tuple[DataFrame, str]]]
    indigenous: DataFrame
    biomes: DataFrame
    continents: DataFrame
    grid: Grid = field(default=GLOBAL)
    buckets: int | None = None


def bucketed(spark: SparkSession, inputs: PanelInputs, prefix: str, buckets: int) -> PanelInputs:
    """The same inputs with every monthly and yearly table written in buckets by cell, as tables named after ``prefix``.

    A panel is built from them without shuffling a layer: the cells are dealt once,
    before the months exist, and each bucket of the panel meets the same bucket of
    every table. Worth its one write where layers serve several panels or runs. The
    session is told that tables dealt by cell need not be dealt again by month.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    written: dict[int, DataFrame] = {}

    def dealt(name: str, table: DataFrame) -> DataFrame:
        if id(table) not in written:
            rows = table.drop("x", "y").repartition(buckets, *CELL_KEY)
            stored = rows.write.bucketBy(buckets, *CELL_KEY).sortBy(*CELL_KEY).mode("overwrite")
            stored.option("path", new_folder(spark, "layer")).saveAsTable(f"{prefix}_{name}")
            written[id(table)] = spark.table(f"{prefix}_{name}")
        return written[id(table)]

    return replace(
        inputs,
        monthly={k: dealt(k, t) for k, t in inputs.monthly.items()},
        yearly={k: dealt(k, t) for k, t in inputs.yearly.items()},
        covers={k: [(dealt(c, t), c) for t, c in classes] for k, classes in inputs.covers.items()},
        buckets=buckets,
    )


def land_cells(spark: SparkSession, inputs: PanelInputs) -> DataFrame:
    """Cells with a region, a biome and a continent, and their land category.

    Everything that does not vary in time is joined here, on the cells, before
    they are multiplied by the months.
    """
    cells = lookup(inputs.regions.where("GFED_Regions <> 0"), region_codes(spark), "GFED_Regions", "Regions")
    marked = inputs.indigenous.select("col", "row").distinct().withColumn("IDL_Layer", F.lit(INDIGENOUS))
    cells = fill_category(join_static(cells, marked), "IDL_Layer", NOT_INDIGENOUS)
    biomes = inputs.biomes.where(F.col("Biomes").between(1, 14))
    cells = keep_known(cells, biomes, ["col", "row"], "Biomes")
    cells = lookup(cells, biome_codes(spark), "Biomes")
    return keep_known(cells, inputs.continents, ["col", "row"], "Continent")


def build_panel(spark: SparkSession, inputs: PanelInputs, first_year: int, last_year: int) -> DataFrame:
    """The full panel for the given years.

    Yearly drivers are joined before the months are generated. The monthly
    tables then share one key, so the growing panel is shuffled once and only
    the right-hand sides follow.
    """
    cells = land_cells(spark, inputs)
    if inputs.buckets:
        cells = cells.repartition(inputs.buckets, *CELL_KEY)
    panel = each_year(cells, first_year, last_year)
    for name, table in inputs.yearly.items():
        panel = keep_known(panel, table, YEAR_KEY, name)
    panel = each_month(panel)
    for name in REQUIRED:
        panel = keep_known(panel, inputs.monthly[name], MONTH_KEY, name)
    for name in OPTIONAL:
        panel = join_monthly(panel, inputs.monthly[name])
    for cover in COVERS:
        classes = [column for _, column in inputs.covers[cover]]
        for i, (table, column) in enumerate(inputs.covers[cover]):
            panel = join_monthly(panel, table.withColumnRenamed(column, f"_{i}"))
        parts = [f"_{i}" for i in range(len(classes))]
        panel = panel.withColumn(cover, row_sum(*parts)).drop(*parts)
    for name in FIRES:
        panel = fill_zero(join_monthly(panel, inputs.monthly[name]), name)
    for name in SMALL_FIRES:
        panel = join_monthly(panel, inputs.monthly[name])
    return with_centres(panel, inputs.grid).select("col", "row", *COLUMNS)


def model_columns(panel: DataFrame) -> DataFrame:
    """The panel without its description columns."""
    return panel.drop("GFED_Regions_Desc", "Biomes_Desc")
