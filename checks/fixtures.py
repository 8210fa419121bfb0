"""Panel-shaped tables derived from the given ones, in Spark and in SQL.

Cells are ``l_partkey % 24`` by ``l_suppkey % 10``. Values are whole numbers
(quantities, cents, per cents), so sums and means agree exactly in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.lineage import materialise
from emberframe.operators.grid import Grid
from emberframe.plans.panel_build import PanelInputs

GRID = Grid(-180.0, -174.0, 87.5, 90.0, 24, 10)
FIRST, LAST = 1995, 2001

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def check(covers: str, sql: str | None = None):
    """Register a query under its function name; ``covers`` lists survey entries."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = tuple(covers.split())
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- observations: one row per line item, on the grid ------------------------


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_partkey") % GRID.ncol).cast("int").alias("col"),
        (F.col("l_suppkey") % GRID.nrow).cast("int").alias("row"),
        F.year("l_shipdate").alias("Year"),
        F.month("l_shipdate").alias("Month"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


OBS = """obs AS (SELECT CAST(l_partkey % 24 AS INT) AS col, CAST(l_suppkey % 10 AS INT) AS "row",
  CAST(year(l_shipdate) AS INT) AS "Year", CAST(month(l_shipdate) AS INT) AS "Month", l_linenumber AS line,
  l_quantity AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_tax * 100) AS BIGINT) AS tax,
  CAST(round(l_discount * 100) AS BIGINT) AS disc,
  l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""

XY = """CAST(-180.0 + (col + 0.5) * 0.25 AS DOUBLE) AS x, CAST(90.0 - ("row" + 0.5) * 0.25 AS DOUBLE) AS y"""
KEY = """col, "row", "Year", "Month\""""

EMPTIED = 23
"""One in so many values of a layer is left empty, by what its cell-month adds up to."""

# Monthly layers, valid in Spark and DuckDB alike. Each reads every row.
AGGREGATES = {
    "TMax": "avg(qty)",
    "DTR": "max(qty) - min(qty) + avg(tax)",
    "NrWetDays": "avg(disc)",
    "PET": "max(qty)",
    "Precipitation": "avg(cents)",
    "RoadDensity": "sum(tax)",
    "DistUrbPop": "min(cents)",
    "LAI": "min(CASE WHEN disc <= 8 THEN qty END)",
    "fPAR": "max(CASE WHEN disc >= 2 THEN cents END)",
    "LC_TreeBE": "avg(CASE WHEN disc <= 1 THEN tax END)",
    "LC_TreeNE": "avg(CASE WHEN disc IN (2, 3) THEN tax END)",
    "LC_TreeBD": "avg(CASE WHEN disc IN (4, 5) THEN tax END)",
    "LC_TreeND": "avg(CASE WHEN disc IN (6, 7) THEN tax END)",
    "LC_ShrubBE": "avg(CASE WHEN disc IN (4, 5) THEN qty END)",
    "LC_ShrubNE": "avg(CASE WHEN disc IN (6, 7) THEN qty END)",
    "LC_ShrubBD": "avg(CASE WHEN disc >= 8 THEN qty END)",
    "LC_Crop": "avg(CASE WHEN disc >= 8 THEN tax END)",
    "LC_Herbs": "max(CASE WHEN disc >= 9 THEN tax END)",
    "LC_Bare": "min(CASE WHEN disc IN (3, 4) THEN tax END)",
    "Size": "sum(CASE WHEN flag = 'R' THEN cents END)",
    "Duration": "sum(CASE WHEN flag IN ('R', 'A') THEN qty END)",
    "Ignitions": "nullif(sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END), 0)",
    "BurnedFraction": "max(tax)",
    "Emissions": "sum(tax)",
}
MONTHLY = {
    name: f"CASE WHEN sum(cents) % {EMPTIED} = {k % EMPTIED} THEN NULL ELSE CAST({aggregate} AS DOUBLE) END"
    for k, (name, aggregate) in enumerate(AGGREGATES.items())
}


def monthly(spark: SparkSession, folder: str, name: str) -> DataFrame:
    layer = observations(spark, folder).groupBy("col", "row", "Year", "Month").agg(F.expr(MONTHLY[name]).alias(name))
    return layer.dropna(subset=[name])


def monthly_sql(name: str) -> str:
    return f"""m_{name} AS (SELECT * FROM (SELECT {KEY}, {MONTHLY[name]} AS "{name}" FROM obs GROUP BY {KEY})
  WHERE "{name}" IS NOT NULL)"""


def population(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly layer."""
    layer = observations(spark, folder).groupBy("col", "row", "Year").agg(
        F.avg("tax").alias("PopDensity"), F.sum("cents").alias("all")
    )
    return layer.where(F.col("all") % EMPTIED != 0).drop("all")


POPULATION = f"""m_pop AS (SELECT col, "row", "Year", avg(tax) AS "PopDensity" FROM obs GROUP BY ALL
  HAVING sum(cents) % {EMPTIED} <> 0)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select("col", "row").distinct()


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).withColumn("GFED_Regions", ((7 * F.col("col") + F.col("row")) % 15).cast("int"))


def indigenous(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).where("(col + row) % 3 = 0")


def biomes(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).withColumn("Biomes", F.expr("CAST(element_at(array(1, 2, 4, 6, 7, 8, 13, 0), col % 8 + 1) AS INT)"))


def continents(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("Continent"))
    return cells(spark, folder).withColumn("k", F.col("row") % 6).join(names, "k").drop("k")


CELLS = 'cells AS (SELECT DISTINCT col, "row" FROM obs)'
REGIONS = 'regions AS (SELECT col, "row", CAST((7 * col + "row") % 15 AS INT) AS "GFED_Regions" FROM cells)'
INDIGENOUS = 'indig AS (SELECT col, "row" FROM cells WHERE (col + "row") % 3 = 0)'
BIOMES = 'biomes AS (SELECT col, "row", CAST([1, 2, 4, 6, 7, 8, 13, 0][col % 8 + 1] AS INT) AS "Biomes" FROM cells)'
CONTINENTS = """continents AS (SELECT col, "row", r_name AS "Continent" FROM cells JOIN region ON r_regionkey = "row" % 6)"""


def codes_sql(name: str, first: int, labels: tuple[str, ...], code: str, text: str) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(labels, start=first))
    return f'{name}({code}, {text}) AS (VALUES {values})'


def all_monthly(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every monthly layer, aggregated in one pass and written before use."""
    wide = observations(spark, folder).groupBy("col", "row", "Year", "Month").agg(
        *[F.expr(aggregate).alias(n) for n, aggregate in MONTHLY.items()]
    )
    wide = materialise(wide, "layers")
    return {n: wide.select("col", "row", "Year", "Month", n).dropna(subset=[n]) for n in MONTHLY}


def panel_inputs(spark: SparkSession, folder: str) -> PanelInputs:
    m = all_monthly(spark, folder)
    tree = [(m[c], c) for c in ("LC_TreeBE", "LC_TreeNE", "LC_TreeBD", "LC_TreeND")]
    shrub = [(m[c], c) for c in ("LC_ShrubBE", "LC_ShrubNE", "LC_ShrubBD")]
    single = {c: [(m[c], c)] for c in ("LC_Crop", "LC_Herbs", "LC_Bare")}
    return PanelInputs(
        regions=regions(spark, folder),
        monthly=m,
        yearly={"PopDensity": population(spark, folder)},
        covers={"LC_Tree": tree, "LC_Shrub": shrub, **single},
        indigenous=indigenous(spark, folder),
        biomes=biomes(spark, folder),
        continents=continents(spark, folder),
        grid=GRID,
    )


def base_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Land cells by month."""
    from emberframe.operators.grid import grid_by_timeline

    return grid_by_timeline(regions(spark, folder).where("GFED_Regions <> 0"), FIRST, LAST)


BASE = f"""base AS (SELECT col, "row", "GFED_Regions", CAST(y.v AS INT) AS "Year", CAST(m.v AS INT) AS "Month"
  FROM regions, range({FIRST}, {LAST + 1}) y(v), range(1, 13) m(v) WHERE "GFED_Regions" <> 0)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def panel_sql() -> str:
    """The whole panel as common table expressions ending in ``panel``."""
    from emberframe.plans.codes import BIOMES as BIOME_NAMES
    from emberframe.plans.codes import REGIONS as REGION_NAMES

    layers = [monthly_sql(n) for n in MONTHLY]
    inner = ["TMax", "DTR", "NrWetDays", "PET", "Precipitation", "RoadDensity", "DistUrbPop"]
    left = [n for n in MONTHLY if n not in inner]
    joins = "\n".join(f"  JOIN m_{n} USING ({KEY})" for n in inner)
    joins += "\n" + "\n".join(f"  LEFT JOIN m_{n} USING ({KEY})" for n in left)
    zero = lambda *names: " + ".join(f'coalesce("{n}", 0.0)' for n in names)
    return with_sql(
        OBS, CELLS, REGIONS, INDIGENOUS, BIOMES, CONTINENTS, BASE, POPULATION, *layers,
        codes_sql("region_codes", 0, REGION_NAMES, '"Regions"', '"GFED_Regions_Desc"'),
        codes_sql("biome_codes", 1, BIOME_NAMES, '"Biomes"', '"Biomes_Desc"'),
        f"""panel AS (SELECT col, "row", {XY}, "Year", "Month", "GFED_Regions", "GFED_Regions_Desc",
  "TMax", "DTR", "NrWetDays", "PET", "Precipitation", "RoadDensity", "DistUrbPop", "PopDensity", "LAI", "fPAR",
  0.0 + {zero('LC_TreeBE', 'LC_TreeNE', 'LC_TreeBD', 'LC_TreeND')} AS "LC_Tree",
  0.0 + {zero('LC_ShrubBE', 'LC_ShrubNE', 'LC_ShrubBD')} AS "LC_Shrub",
  {zero('LC_Crop')} AS "LC_Crop", {zero('LC_Herbs')} AS "LC_Herbs", {zero('LC_Bare')} AS "LC_Bare",
  {zero('Size')} AS "Size", {zero('Duration')} AS "Duration", {zero('Ignitions')} AS "Ignitions",
  CASE WHEN indig.col IS NULL THEN 'None Indigenous Land' ELSE 'Indigenous Land' END AS "IDL_Layer",
  "Biomes", "Biomes_Desc", "Continent", "BurnedFraction", "Emissions"
  FROM base JOIN biomes USING (col, "row") JOIN biome_codes USING ("Biomes") JOIN continents USING (col, "row")
  JOIN region_codes ON "GFED_Regions" = "Regions" LEFT JOIN indig USING (col, "row")
  JOIN m_pop USING (col, "row", "Year")
{joins})""",
    )


# --- model rows: one per line item -------------------------------------------

DRIVERS = ("l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "s_acctbal")


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with part and supplier attributes; response ``y`` is a log price."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        "l_quantity", "l_discount", "l_tax",
    )
    return (
        items
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_linenumber", "p_brand", "s_nationkey", "l_returnflag", "l_linestatus",
            F.log("l_extendedprice").alias("y"),
            (F.col("l_returnflag") == "R").cast("double").alias("returned"),
            (F.col("l_linestatus") == "O").cast("double").alias("open"),
            *[F.col(d).cast("double").alias(d) for d in DRIVERS],
        )
    )


MODEL_ROWS = """rows_ AS (SELECT l_orderkey, l_linenumber, p_brand, s_nationkey, l_returnflag, l_linestatus,
  ln(l_extendedprice) AS y, CAST(l_returnflag = 'R' AS DOUBLE) AS returned, CAST(l_linestatus = 'O' AS DOUBLE) AS open,
  CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
  CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CAST(s_acctbal AS DOUBLE) AS s_acctbal
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer attributes, keyed by o_orderkey."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return (
        orders
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", "c_mktsegment", "o_orderstatus",
            F.log("o_totalprice").alias("y"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("v"),
        )
    )


ORDER_ROWS = """rows_ AS (SELECT o_orderkey, c_mktsegment, o_orderstatus, ln(o_totalprice) AS y, o_totalprice AS price,
  c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey)"""
