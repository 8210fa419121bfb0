"""Grids, slabs, matrices, polygons and file sources."""

from pyspark.sql import functions as F

from emberframe.lineage import new_folder
from emberframe.operators import grid as G
from emberframe.operators.panel import join_monthly
from emberframe.operators.rasterize import rasterize
from emberframe.sources import ascii_grid, layers, polygons, slabs, tables

from .fixtures import (
    BASE, CELLS, GRID, KEY, OBS, POPULATION, REGIONS, base_grid, check, monthly, monthly_sql, observations, population,
    table, with_sql,
)

SMALL = G.Grid(-180.0, 180.0, -90.0, 90.0, 8, 8)

# whole numbers from the first 64 embedding values; -5 stands for missing
LONG = f"""long AS (SELECT vec_id AS layer, CAST(a.v AS INT) AS first, CAST(b.v AS INT) AS second,
  CAST(floor(CAST(embedding[a.v * 8 + b.v + 1] AS DOUBLE) * 100) AS DOUBLE) AS value
  FROM embeddings, range(8) a(v), range(8) b(v))"""
X8 = "CAST(-180.0 + (col + 0.5) * 45.0 AS DOUBLE) AS x"
Y8 = """CAST(90.0 - ("row" + 0.5) * 22.5 AS DOUBLE) AS y"""


def matrices(spark, folder):
    """layer, values: 8 by 8 arrays of whole numbers."""
    line = lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda e: F.floor(e.cast("double") * 100).cast("double"))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("layer"), F.array(*[line(i) for i in range(8)]).alias("values")
    )


@check(
    "SC4 GR4 GR5 GR7",
    f"WITH {LONG} SELECT layer, first AS col, second AS \"row\", value FROM long WHERE value <> -5",
)
def slab_rows(spark, folder):
    """Slab to rows: the first dimension is longitude, the fill value is dropped."""
    return slabs.slab_points(matrices(spark, folder), fill=-5.0)


@check(
    "GR6 GR5",
    f"WITH {LONG} SELECT layer, first AS col, CAST(7 - second AS INT) AS \"row\", value FROM long WHERE value <> -5",
)
def flipped_slab_rows(spark, folder):
    return slabs.slab_points(matrices(spark, folder), fill=-5.0, flip_y=8)


@check("GR7", f"WITH {LONG} SELECT layer, second AS col, first AS \"row\", value FROM long")
def transposed_rows(spark, folder):
    return G.transpose(slabs.slab_points(matrices(spark, folder)))


@check(
    "SC5 GR3",
    f"""WITH {LONG}, m AS (SELECT CAST(2003 + layer // 12 AS INT) AS "Year", CAST(layer % 12 + 1 AS INT) AS "Month",
  second AS col, first AS "row", value FROM long)
SELECT "Year", "Month", col, "row", {X8}, {Y8}, value FROM m""",
)
def month_matrix_rows(spark, folder):
    """Month matrices to rows, on a timeline long enough for all of them."""
    last = matrices(spark, folder).agg(F.max("layer")).first()[0]
    months = G.layer_period(matrices(spark, folder), 2003, 2003 + last // 12).drop("layer")
    return slabs.matrix_points(months, SMALL).select("Year", "Month", "col", "row", "x", "y", "value")


@check(
    "GR3",
    """SELECT vec_id, layer, CAST(2003 + layer // 12 AS INT) AS "Year", CAST(layer % 12 + 1 AS INT) AS "Month"
FROM (SELECT vec_id, vec_id % 180 AS layer FROM embeddings) WHERE layer < 168""",
)
def layer_months(spark, folder):
    """A stack of 180 layers on a timeline of 168 months: layers past its end have no month."""
    named = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 180).alias("layer"))
    return G.layer_period(named, 2003, 2016)


@check("GR4", "SELECT l_orderkey, nullif(l_discount, 0.1) AS l_discount FROM lineitem")
def sentinel_values(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_discount")
    return G.sentinel_to_null(rows, "l_discount", 0.1)


@check(
    "GR1",
    with_sql(OBS)
    + """SELECT c.col, c."row", CAST(-180.0 + (c.col + 0.5) * 0.25 AS DOUBLE) AS x,
  CAST(90.0 - (c."row" + 0.5) * 0.25 AS DOUBLE) AS y, count(qty) AS n
FROM (SELECT CAST(i % 24 AS INT) AS col, CAST(i // 24 AS INT) AS "row" FROM range(240) r(i)) c
LEFT JOIN obs USING (col, "row") GROUP BY ALL""",
)
def grid_counts(spark, folder):
    """Every cell of the grid with its centre and number of observations."""
    seen = observations(spark, folder).groupBy("col", "row").agg(F.count("qty").alias("n"))
    return G.grid_cells(spark, GRID).join(seen, ["col", "row"], "left").fillna(0, subset=["n"])


@check(
    "GR2",
    with_sql(OBS)
    + """SELECT CAST(y.v AS INT) AS "Year", CAST(m.v AS INT) AS "Month", count(qty) AS n
FROM range(1994, 2004) y(v) CROSS JOIN range(1, 13) m(v) LEFT JOIN obs ON obs."Year" = y.v AND obs."Month" = m.v GROUP BY ALL""",
)
def months_counts(spark, folder):
    """Every month of a timeline with its number of observations."""
    seen = observations(spark, folder).groupBy("Year", "Month").agg(F.count("qty").alias("n"))
    months = G.timeline(spark, 1994, 2003).drop("layer")
    return months.join(seen, ["Year", "Month"], "left").fillna(0, subset=["n"])


SOURCE = G.Grid(-100.0, 60.0, -50.0, 70.0, 8, 8)
TARGET = G.Grid(-180.0, 180.0, -90.0, 90.0, 48, 30)
REGRID = """t AS (SELECT CAST(c.v AS INT) AS col, CAST(r.v AS INT) AS "row", CAST(-180.0 + (c.v + 0.5) * 7.5 AS DOUBLE) AS x,
  CAST(90.0 - (r.v + 0.5) * 6.0 AS DOUBLE) AS y FROM range(48) c(v), range(30) r(v))"""


@check(
    "GR8",
    f"""WITH {LONG}, {REGRID} SELECT layer, t.col, t."row", t.x, t.y, value FROM t JOIN long
ON first = floor((x + 100) / 20) AND second = 7 - floor((70 - y) / 15)
WHERE x BETWEEN -100 AND 60 AND y BETWEEN -50 AND 70 AND value <> -5""",
)
def regridded_slabs(spark, folder):
    """Slabs flipped, cleaned and brought to the target grid by nearest cell."""
    return slabs.slab_to_grid(matrices(spark, folder), SOURCE, TARGET, fill=-5.0)


@check(
    "GR8",
    f"""WITH {LONG}, {REGRID} SELECT layer, t.col, t."row", value FROM t JOIN long
ON first = least(floor((x + 100) / 20), 7) AND second = least(floor((60 - y) / 13.75), 7)
WHERE x BETWEEN -100 AND 60 AND y BETWEEN -50 AND 60""",
)
def regridded_points(spark, folder):
    """Unflipped, with cells that do not divide the target evenly."""
    source = G.Grid(-100.0, 60.0, -50.0, 60.0, 8, 8)
    return G.regrid_nearest(slabs.slab_points(matrices(spark, folder)), source, TARGET).drop("x", "y")


@check(
    "GR10",
    f"""WITH {LONG}, m AS (SELECT layer, second AS col, first AS "row", value FROM long)
SELECT layer, col, "row", {X8}, {Y8}, value FROM m""",
)
def bound_positions(spark, folder):
    """A flat vector lines up with the grid by position."""
    flat = matrices(spark, folder).select("layer", F.posexplode(F.flatten("values")).alias("pos", "value"))
    return G.bind_positions(flat, "pos", SMALL)


@check(
    "GR11",
    with_sql(OBS, monthly_sql("TMax"))
    + """SELECT col, "row", arg_max("TMax", "Year" * 100 + "Month") AS "TMax" FROM m_TMax WHERE "Year" = 1997 GROUP BY ALL""",
)
def map_of_a_year(spark, folder):
    return G.map_layer(monthly(spark, folder, "TMax"), "TMax", F.col("Year") == 1997)


@check(
    "GR12",
    with_sql(OBS, POPULATION)
    + """SELECT col, "row", round(ln("PopDensity" + 1), 8) AS "PopDensity" FROM m_pop WHERE "Year" = 1999""",
)
def log_map_of_a_year(spark, folder):
    one = population(spark, folder).withColumn("Month", F.lit(12))
    layer = G.map_layer(one, "PopDensity", F.col("Year") == 1999)
    return layer.withColumn("PopDensity", F.round(F.log1p("PopDensity"), 8))


# --- polygons ----------------------------------------------------------------

# One five-sided ring and one hole per supplier, placed and sized by its key.
SHAPE = ((-0.9, -0.4), (0.35, -0.85), (1.15, 0.1), (0.2, 0.75), (-0.6, 0.5))
HOLE = ((-0.3, -0.2), (0.3, -0.2), (0.0, 0.3))
CENTRE_X = "(-179.5 + (s_suppkey % 21) * 0.25)"
CENTRE_Y = "(87.9 + (s_suppkey % 7) * 0.25)"


def edges_sql() -> str:
    rows = []
    for points in (SHAPE, HOLE):
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            rows.append(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)")
    cx, cy = CENTRE_X.replace("0.25", "0.25::DOUBLE"), CENTRE_Y.replace("0.25", "0.25::DOUBLE")
    return f"""edges AS (SELECT s_suppkey AS feature, s_nationkey, {cx} + ax AS x1, {cy} + ay AS y1,
  {cx} + bx AS x2, {cy} + by_ AS y2 FROM supplier, (VALUES {', '.join(rows)}) s(ax, ay, bx, by_))"""


def write_polygons(spark, folder) -> str:
    """Supplier polygons as GeoJSON, one feature per line."""
    path = new_folder(spark, "polygons")
    base = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "s_nationkey", "-179.5D + (s_suppkey % 21) * 0.25D AS cx", "87.9D + (s_suppkey % 7) * 0.25D AS cy"
    )

    def ring(points):
        corners = [F.array(F.col("cx") + dx, F.col("cy") + dy) for dx, dy in points]
        return F.array(*corners, corners[0])

    features = base.select(
        F.lit("Feature").alias("type"),
        F.struct("s_suppkey", "s_nationkey").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring(SHAPE), ring(HOLE)).alias("coordinates")).alias("geometry"),
    )
    features.write.json(path)
    return path


def read_polygons(spark, folder):
    return polygons.polygon_rings(
        spark, write_polygons(spark, folder), {"s_suppkey": "bigint", "s_nationkey": "int"}, order="s_suppkey"
    )


@check(
    "SC6",
    f"WITH {edges_sql()} SELECT feature, s_nationkey, x1 AS x, y1 AS y FROM edges",
)
def polygon_corners(spark, folder):
    """Corners of every ring, the closing one left out."""
    rings = read_polygons(spark, folder)
    open_ring = F.slice("ring", 1, F.size("ring") - 1)
    return rings.select("feature", "s_nationkey", F.explode(open_ring).alias("p")).select("feature", "s_nationkey", "p.x", "p.y")


@check(
    "GR9",
    f"""WITH {edges_sql()}, cells AS (SELECT CAST(i % 24 AS INT) AS col, CAST(i // 24 AS INT) AS "row",
  CAST(-180.0 + (i % 24 + 0.5) * 0.25 AS DOUBLE) AS x, CAST(90.0 - (i // 24 + 0.5) * 0.25 AS DOUBLE) AS y FROM range(240) r(i)),
inside AS (SELECT col, "row", x, y, feature, s_nationkey FROM cells, edges WHERE (y1 <= y) <> (y2 <= y)
  AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT col, "row", x, y, arg_max(s_nationkey, feature) AS s_nationkey FROM inside GROUP BY ALL""",
)
def polygons_to_cells(spark, folder):
    """Cells inside each polygon but not in its hole; the last polygon wins."""
    return rasterize(read_polygons(spark, folder), "s_nationkey", GRID)


# --- files -------------------------------------------------------------------


@check(
    "SC1",
    with_sql(OBS, monthly_sql("LC_TreeBE"), monthly_sql("LC_TreeNE"))
    + f"""SELECT {KEY}, "LC_TreeBE" AS value FROM m_LC_TreeBE UNION ALL SELECT {KEY}, "LC_TreeNE" FROM m_LC_TreeNE""",
)
def csv_by_header(spark, folder):
    """Two CSV tables with different column orders, read by name."""
    first, second = new_folder(spark, "csv"), new_folder(spark, "csv")
    tables.write_csv(monthly(spark, folder, "LC_TreeBE"), first)
    tables.write_csv(monthly(spark, folder, "LC_TreeNE").select("LC_TreeNE", "Month", "Year", "row", "col"), second)
    key = {"col": "int", "row": "int", "Year": "int", "Month": "int"}
    a = tables.csv_table(spark, first, {**key, "LC_TreeBE": "double"}).withColumnRenamed("LC_TreeBE", "value")
    b = tables.csv_table(spark, second, {**key, "LC_TreeNE": "double"}).withColumnRenamed("LC_TreeNE", "value")
    return a.unionByName(b)


@check(
    "SC2",
    with_sql(OBS, POPULATION)
    + """SELECT CAST("Year" - (SELECT min("Year") FROM m_pop) AS INT) AS layer, col, "row", "PopDensity" FROM m_pop""",
)
def stacked_files(spark, folder):
    """One file per year; the place of the file in name order is the layer."""
    path = new_folder(spark, "stack")
    population(spark, folder).repartition("Year").write.partitionBy("Year").csv(path, header=True)
    names = layers.layer_names(spark, path, "*.csv")
    rows = spark.read.option("recursiveFileLookup", "true").csv(path, header=True)
    rows = rows.select("col", "row", "PopDensity", F.col("_metadata.file_path").alias("path"))
    typed = layers.with_layer(rows, names)
    return typed.select(
        "layer", F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row"),
        F.col("PopDensity").cast("double").alias("PopDensity"),
    )


@check(
    "SC3 SC2",
    with_sql(OBS, POPULATION)
    + """SELECT CAST("Year" - (SELECT min("Year") FROM m_pop) AS INT) AS layer, col, "row",
  CAST(-180.0 + (col + 0.5) * 0.25 AS DOUBLE) AS x, CAST(87.5 + (10 - "row" - 0.5) * 0.25 AS DOUBLE) AS y,
  "PopDensity" AS value FROM m_pop""",
)
def ascii_grid_rows(spark, folder):
    """Yearly ASCII grids written from the population layer and read back."""
    path = new_folder(spark, "asc")
    full = G.each_year(G.grid_cells(spark, GRID), 1995, 2001).join(
        population(spark, folder), ["col", "row", "Year"], "left"
    )
    years = population(spark, folder).select("Year").distinct()
    line = full.join(years, "Year").groupBy("Year", "row").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col", F.coalesce("PopDensity", F.lit(-9999.0)).alias("v")))),
                lambda s: s["v"].cast("string"),
            ),
            " ",
        ).alias("line")
    )
    header = "ncols 24\nnrows 10\nxllcorner -180\nyllcorner 87.5\ncellsize 0.25\nNODATA_value -9999\n"
    texts = line.groupBy("Year").agg(
        F.concat(
            F.lit(header),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n"),
        ).alias("value")
    )
    texts.repartition("Year").write.partitionBy("Year").text(path)
    rows = ascii_grid.ascii_grids(spark, path, "*.txt")
    names = layers.layer_names(spark, path, "*.txt")
    return layers.with_layer(rows, names).select("layer", "col", "row", "x", "y", "value")


@check(
    "SC7 SK1",
    with_sql(OBS, CELLS, REGIONS, BASE, monthly_sql("LAI"))
    + f""", n AS (SELECT count(*) AS rows_, count(*) - count("LAI") AS missing_ FROM base LEFT JOIN m_LAI USING ({KEY}))
SELECT c AS "column", rows_ AS rows_written, CASE c WHEN 'LAI' THEN missing_ ELSE 0 END AS missing_written,
  rows_ AS rows_read, CASE c WHEN 'LAI' THEN missing_ ELSE 0 END AS missing_read, true AS same
FROM n, (VALUES ('col'), ('row'), ('GFED_Regions'), ('Year'), ('Month'), ('LAI')) t(c)""",
)
def written_and_read_back(spark, folder):
    """A table written as CSV has the same rows and missing values when read."""
    layer = join_monthly(base_grid(spark, folder), monthly(spark, folder, "LAI"))
    path = tables.write_csv(layer, new_folder(spark, "panel"))
    kinds = {"col": "int", "row": "int", "GFED_Regions": "int", "Year": "int", "Month": "int", "LAI": "double"}
    return tables.read_back_check(layer, tables.csv_table(spark, path, kinds))


@check(
    "SK1",
    with_sql(OBS, monthly_sql("Size")) + """SELECT col, "row", "Year", "Month", "Size" FROM m_Size WHERE "Year" = 1998""",
)
def parquet_by_year(spark, folder):
    """Written by year, so that a year filter reads one folder."""
    path = tables.write_parquet(monthly(spark, folder, "Size"), new_folder(spark, "parquet"))
    return spark.read.parquet(path).where("Year = 1998")
