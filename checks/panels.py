"""Joins, filters and columns of the panel."""

import uuid

from pyspark.sql import functions as F

from emberframe.functions.scalar import fixed_width, is_missing, joined_text, zero_if_missing
from emberframe.operators import panel as P
from emberframe.operators.grid import grid_by_timeline, with_centres
from emberframe.operators.profile import count_by
from emberframe.plans.codes import REGIONS as REGION_NAMES
from emberframe.plans.codes import region_codes
from emberframe.plans.panel_build import bucketed, build_panel, model_columns

from .fixtures import (
    BASE, BIOMES, CELLS, CONTINENTS, FIRST, GRID, INDIGENOUS, KEY, LAST, OBS, POPULATION, REGIONS, XY,
    base_grid, biomes, check, codes_sql, continents, indigenous, monthly, monthly_sql, observations, panel_inputs,
    panel_sql, population, regions, with_sql,
)

PANEL = panel_sql()
REGION_CODES = codes_sql("region_codes", 0, REGION_NAMES, '"Regions"', '"GFED_Regions_Desc"')


def full_panel(spark, folder):
    return build_panel(spark, panel_inputs(spark, folder), FIRST, LAST)


@check(
    "JN1 JN2 JN6 JN7",
    PANEL
    + """SELECT "Biomes", "IDL_Layer", "Year", count(*) AS n, CAST(sum("Duration") AS DOUBLE) AS duration, count("LAI") AS with_lai, count(nullif("LC_Crop", 0)) AS crops
FROM panel GROUP BY ALL""",
)
def panel_from_buckets(spark, folder):
    """The panel from layers written in buckets by cell, which no join shuffles."""
    inputs = bucketed(spark, panel_inputs(spark, folder), f"layer_{uuid.uuid4().hex}", 8)
    panel = build_panel(spark, inputs, FIRST, LAST)
    return panel.groupBy("Biomes", "IDL_Layer", "Year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("Duration").alias("duration"),
        F.count("LAI").alias("with_lai"),
        F.count(F.nullif("LC_Crop", F.lit(0))).alias("crops"),
    )


@check(
    "JN6 JN7 JN1 PF18 JN4 PF21 AG8",
    with_sql(
        OBS, CELLS, REGIONS, INDIGENOUS, BASE, monthly_sql("TMax"), monthly_sql("Size"), REGION_CODES,
    )
    + f"""SELECT "GFED_Regions", "GFED_Regions_Desc",
  CASE WHEN indig.col IS NULL THEN 'None Indigenous Land' ELSE 'Indigenous Land' END AS "IDL_Layer",
  count(*) AS cell_months, CAST(sum(CASE WHEN coalesce("Size", 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_fire,
  CAST(sum(CASE WHEN coalesce("Size", 0) > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate
FROM base JOIN m_TMax USING ({KEY}) LEFT JOIN m_Size USING ({KEY}) LEFT JOIN indig USING (col, "row")
JOIN region_codes ON "GFED_Regions" = "Regions" GROUP BY ALL""",
)
def presence_rate(spark, folder):
    """Share of cell-months with fire, by region and land category."""
    marked = indigenous(spark, folder).withColumn("IDL_Layer", F.lit("Indigenous Land"))
    cells = P.lookup(regions(spark, folder).where("GFED_Regions <> 0"), region_codes(spark), "GFED_Regions", "Regions")
    cells = P.fill_category(P.join_static(cells, marked), "IDL_Layer", "None Indigenous Land")
    rows = P.keep_known(grid_by_timeline(cells, FIRST, LAST), monthly(spark, folder, "TMax"), P.MONTH_KEY, "TMax")
    rows = P.fill_zero(P.join_monthly(rows, monthly(spark, folder, "Size")), "Size")
    return (
        P.binary_response(rows).groupBy("GFED_Regions", "GFED_Regions_Desc", "IDL_Layer")
        .agg(
            F.count(F.lit(1)).alias("cell_months"),
            F.sum("Fire").cast("bigint").alias("with_fire"),
            (F.sum("Fire") / F.count(F.lit(1))).alias("rate"),
        )
    )


@check("JN1 JN2 JN3 JN4 JN5 JN6 JN7 PF2 PF18 PF19 PF20", PANEL + "SELECT * FROM panel")
def whole_panel(spark, folder):
    """The panel with all its drivers and responses."""
    return full_panel(spark, folder)


@check("PF11", PANEL + """SELECT * FROM panel WHERE "Size" <> 0 AND "Ignitions" <> 0 AND "Duration" <> 0""")
def presence_panel(spark, folder):
    return P.fire_presence(full_panel(spark, folder))


@check("PF12", PANEL + """SELECT * FROM panel WHERE "BurnedFraction" <> 0 AND "Emissions" <> 0""")
def small_fire_panel(spark, folder):
    return P.small_fire_presence(full_panel(spark, folder))


@check(
    "PF5 PF6",
    PANEL + """SELECT * EXCLUDE ("GFED_Regions_Desc", "Biomes_Desc") FROM panel WHERE "Year" = 1998""",
)
def one_year_extract(spark, folder):
    return model_columns(full_panel(spark, folder)).where("Year = 1998")


@check(
    "PF13 PF14 PF16",
    PANEL
    + """SELECT col, "row", "Year", "Month", "LAI", "fPAR", "LC_Bare", "BurnedFraction", "Emissions" FROM panel
WHERE "Year" <> 2001 AND "Biomes" = 6 AND "LC_Bare" <> 1 AND "LAI" IS NOT NULL AND "fPAR" IS NOT NULL
  AND "BurnedFraction" IS NOT NULL AND "Emissions" IS NOT NULL""",
)
def biome_rows(spark, folder):
    rows = P.not_bare(P.stratum(full_panel(spark, folder), biome=6, without_year=2001))
    return P.drop_incomplete(rows).select(
        "col", "row", "Year", "Month", "LAI", "fPAR", "LC_Bare", "BurnedFraction", "Emissions"
    )


@check(
    "PF21 PF23",
    PANEL
    + """SELECT col, "row", "Year", "Month", CASE WHEN "Size" > 0 THEN 1.0::DOUBLE ELSE "Size" END AS "Fire",
  CASE "IDL_Layer" WHEN 'Indigenous Land' THEN 'IDL' ELSE 'No_IDL' END AS "IDL_Layer" FROM panel""",
)
def presence_labels(spark, folder):
    rows = P.relabel(P.binary_response(full_panel(spark, folder)), "IDL_Layer", ("IDL", "No_IDL"))
    return rows.select("col", "row", "Year", "Month", "Fire", "IDL_Layer")


@check(
    "PF15",
    PANEL
    + """SELECT x, y, "Year", "Month", "Size" FROM panel WHERE "IDL_Layer" = 'Indigenous Land'""",
)
def indigenous_rows(spark, folder):
    return full_panel(spark, folder).where("IDL_Layer = 'Indigenous Land'").select("x", "y", "Year", "Month", "Size")


# --- joins, one at a time ----------------------------------------------------


@check(
    "JN1",
    with_sql(OBS, CELLS, REGIONS, BASE, monthly_sql("LAI"))
    + f"""SELECT {KEY}, "GFED_Regions", "LAI" FROM base LEFT JOIN m_LAI USING ({KEY})""",
)
def monthly_left_join(spark, folder):
    return P.join_monthly(base_grid(spark, folder), monthly(spark, folder, "LAI"))


@check(
    "JN1",
    with_sql(OBS, CELLS, REGIONS, BASE)
    + f"""SELECT {KEY}, line, count(*) AS n, sum(qty) AS qty FROM base LEFT JOIN obs USING ({KEY}) GROUP BY ALL""",
)
def monthly_join_with_duplicates(spark, folder):
    """Duplicate keys on the right multiply the panel's rows."""
    right = observations(spark, folder).select("col", "row", "Year", "Month", "line", "qty")
    rows = P.join_monthly(base_grid(spark, folder), right)
    return rows.groupBy("col", "row", "Year", "Month", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@check(
    "JN2",
    with_sql(OBS, CELLS, REGIONS, BASE, POPULATION)
    + f"""SELECT {KEY}, "GFED_Regions", "PopDensity" FROM base LEFT JOIN m_pop USING (col, "row", "Year")""",
)
def yearly_left_join(spark, folder):
    return P.join_yearly(base_grid(spark, folder), population(spark, folder))


@check(
    "JN3",
    with_sql(OBS, CELLS, REGIONS, BASE, BIOMES, CONTINENTS)
    + f"""SELECT {KEY}, "GFED_Regions", "Biomes", "Continent" FROM base LEFT JOIN biomes USING (col, "row")
LEFT JOIN continents USING (col, "row")""",
)
def static_left_join(spark, folder):
    rows = P.join_static(base_grid(spark, folder), biomes(spark, folder))
    return P.join_static(rows, continents(spark, folder))


@check(
    "JN4",
    with_sql(OBS, CELLS, REGIONS, REGION_CODES)
    + """SELECT col, "row", "GFED_Regions", "GFED_Regions_Desc" FROM regions
LEFT JOIN region_codes ON "GFED_Regions" = "Regions\"""",
)
def region_lookup(spark, folder):
    return P.lookup(regions(spark, folder), region_codes(spark), "GFED_Regions", "Regions")


@check(
    "JN5",
    """SELECT s_suppkey, s_nationkey AS n_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def same_name_lookup(spark, folder):
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nations = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name")
    return P.lookup(suppliers, nations, "n_nationkey")


@check("JN6", with_sql(OBS, CELLS, REGIONS, BASE) + f"""SELECT {KEY}, {XY}, "GFED_Regions" FROM base""")
def cells_by_month(spark, folder):
    return with_centres(base_grid(spark, folder), GRID)


@check(
    "JN7",
    with_sql(OBS, CELLS, REGIONS, BASE, monthly_sql("LAI"), monthly_sql("LC_Crop"))
    + f"""SELECT {KEY}, "GFED_Regions", "LAI", "LC_Crop" FROM base LEFT JOIN m_LAI USING ({KEY})
LEFT JOIN m_LC_Crop USING ({KEY}) WHERE "LAI" IS NOT NULL AND "LC_Crop" IS NOT NULL""",
)
def join_and_drop_missing(spark, folder):
    rows = P.keep_known(base_grid(spark, folder), monthly(spark, folder, "LAI"), P.MONTH_KEY, "LAI")
    return P.keep_known(rows, monthly(spark, folder, "LC_Crop"), P.MONTH_KEY, "LC_Crop")


# --- columns -----------------------------------------------------------------

SPARSE = with_sql(OBS, CELLS, REGIONS, BASE, monthly_sql("LC_Crop"), monthly_sql("LC_Herbs"), monthly_sql("LC_Bare"))
SPARSE_FROM = f"""FROM base LEFT JOIN m_LC_Crop USING ({KEY}) LEFT JOIN m_LC_Herbs USING ({KEY})
LEFT JOIN m_LC_Bare USING ({KEY})"""


def sparse(spark, folder):
    rows = base_grid(spark, folder)
    for name in ("LC_Crop", "LC_Herbs", "LC_Bare"):
        rows = P.join_monthly(rows, monthly(spark, folder, name))
    return rows


@check("PF1 PF2 PF3", with_sql(OBS) + """SELECT "Month" AS m, "Year" AS yr, col, qty AS "Quantity" FROM obs""")
def reordered_columns(spark, folder):
    """Select in a new order, rename, keep a subset."""
    rows = observations(spark, folder).select("Month", "Year", "col", "qty")
    return rows.withColumnsRenamed({"Month": "m", "Year": "yr", "qty": "Quantity"})


@check(
    "PF4 PF5",
    with_sql(OBS) + """SELECT col, "row", 1 AS "ID", 'Indigenous Land' AS "IDL_Layer", "Year" - 1995 AS since FROM obs""",
)
def constant_and_derived_columns(spark, folder):
    rows = observations(spark, folder).select("col", "row", "Year")
    rows = rows.withColumn("ID", F.lit(1)).withColumn("IDL_Layer", F.lit("Indigenous Land"))
    return rows.withColumn("since", F.col("Year") - 1995).drop("Year")


@check("PF6", with_sql(OBS) + """SELECT col, "row", qty, cents FROM obs WHERE "Month" = 5 AND "Year" = 1996""")
def equality_filter(spark, folder):
    return observations(spark, folder).where("Month = 5 AND Year = 1996").select("col", "row", "qty", "cents")


@check("PF7", with_sql(OBS, CELLS, REGIONS) + """SELECT * FROM regions WHERE "GFED_Regions" <> 0""")
def land_only(spark, folder):
    return regions(spark, folder).where("GFED_Regions <> 0")


@check("PF8", with_sql(OBS, CELLS, BIOMES) + """SELECT * FROM biomes WHERE "Biomes" IN (1, 2, 4, 6)""")
def known_biomes(spark, folder):
    return biomes(spark, folder).where(F.col("Biomes").isin(1, 2, 4, 6))


@check("PF9", with_sql(OBS) + """SELECT col, "row", qty, tax FROM obs WHERE qty <= 20 AND tax > 5""")
def range_filter(spark, folder):
    return observations(spark, folder).where("qty <= 20 AND tax > 5").select("col", "row", "qty", "tax")


@check("PF10", SPARSE + f"""SELECT {KEY}, "GFED_Regions" {SPARSE_FROM} WHERE "LC_Crop" IS NULL""")
def missing_locations(spark, folder):
    return sparse(spark, folder).where(is_missing("LC_Crop")).select("col", "row", "Year", "Month", "GFED_Regions")


@check(
    "PF16",
    SPARSE
    + f"""SELECT {KEY}, "LC_Crop", "LC_Herbs", "LC_Bare" {SPARSE_FROM}
WHERE "LC_Crop" IS NOT NULL AND "LC_Herbs" IS NOT NULL AND "LC_Bare" IS NOT NULL""",
)
def complete_rows(spark, folder):
    return P.drop_incomplete(sparse(spark, folder)).drop("GFED_Regions")


@check(
    "PF17",
    SPARSE
    + f"""SELECT {KEY}, "LC_Crop", "LC_Herbs", "LC_Bare" {SPARSE_FROM}
WHERE "LC_Crop" IS NOT NULL OR "LC_Herbs" IS NOT NULL OR "LC_Bare" IS NOT NULL""",
)
def not_all_missing(spark, folder):
    return P.drop_all_missing(sparse(spark, folder), ["LC_Crop", "LC_Herbs", "LC_Bare"]).drop("GFED_Regions")


@check(
    "PF18",
    SPARSE + f"""SELECT {KEY}, coalesce("LC_Crop", 0.0) AS "LC_Crop", coalesce("LC_Herbs", 0.0) AS "LC_Herbs" {SPARSE_FROM}""",
)
def missing_as_zero(spark, folder):
    rows = P.fill_zero(sparse(spark, folder), "LC_Crop")
    return rows.withColumn("LC_Herbs", zero_if_missing("LC_Herbs")).drop("GFED_Regions", "LC_Bare")


@check(
    "PF19",
    with_sql(OBS, CELLS, INDIGENOUS)
    + """SELECT col, "row", CASE WHEN indig.col IS NULL THEN 'None Indigenous Land' ELSE 'Indigenous Land' END AS "IDL_Layer"
FROM cells LEFT JOIN indig USING (col, "row")""",
)
def missing_category(spark, folder):
    marked = indigenous(spark, folder).withColumn("IDL_Layer", F.lit("Indigenous Land"))
    every = observations(spark, folder).select("col", "row").distinct()
    return P.fill_category(P.join_static(every, marked), "IDL_Layer", "None Indigenous Land")


@check(
    "PF20",
    SPARSE
    + f"""SELECT {KEY}, coalesce("LC_Crop", 0.0) + coalesce("LC_Herbs", 0.0) + coalesce("LC_Bare", 0.0) AS total {SPARSE_FROM}""",
)
def sum_over_columns(spark, folder):
    total = P.row_sum("LC_Crop", "LC_Herbs", "LC_Bare").alias("total")
    return sparse(spark, folder).select("col", "row", "Year", "Month", total)


@check(
    "PF22",
    """SELECT l_orderkey, CAST(l_quantity AS INT) AS q_int, CAST(l_linenumber AS DOUBLE) AS line_num,
  CAST(l_linenumber AS VARCHAR) AS line_text FROM lineitem""",
)
def type_casts(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select(
        "l_orderkey",
        F.col("l_quantity").cast("int").alias("q_int"),
        F.col("l_linenumber").cast("double").alias("line_num"),
        F.col("l_linenumber").cast("string").alias("line_text"),
    )


@check(
    "PF24",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5""",
)
def rows_removed_by_key(spark, folder):
    """The five largest orders are removed by their key."""
    rows = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice")
    largest = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return P.without_rows(rows, largest, ["o_orderkey"])


@check(
    "SO1",
    with_sql(OBS, monthly_sql("LC_TreeBE"), monthly_sql("LC_TreeNE"))
    + f"""SELECT {KEY}, "LC_TreeBE" AS value FROM m_LC_TreeBE UNION ALL SELECT {KEY}, "LC_TreeNE" FROM m_LC_TreeNE""",
)
def appended_rows(spark, folder):
    first = monthly(spark, folder, "LC_TreeBE").withColumnRenamed("LC_TreeBE", "value")
    second = monthly(spark, folder, "LC_TreeNE").withColumnRenamed("LC_TreeNE", "value")
    return first.unionByName(second.select("value", "Month", "Year", "row", "col"))


@check(
    "SL1",
    with_sql(OBS, monthly_sql("TMax")) + f"""SELECT * FROM m_TMax ORDER BY {KEY} LIMIT 6""",
)
def first_rows(spark, folder):
    return monthly(spark, folder, "TMax").orderBy("col", "row", "Year", "Month").limit(6)


@check(
    "SF1 SF2 SF3 SF4 SF5 SF6 SF7",
    """SELECT o_orderkey, round(ln(o_totalprice), 8) AS log_, round(ln(o_totalprice + 1), 8) AS log_1,
  round(log10(o_totalprice), 8) AS log10_, round(log10(o_totalprice + 1), 8) AS log10_1,
  round(sqrt(o_totalprice), 8) AS root, round(cbrt(o_totalprice - 250000), 8) AS cube_root,
  CAST(o_custkey AS DOUBLE) * o_custkey AS squared, CAST(o_custkey AS DOUBLE) * o_orderkey AS product_ FROM orders""",
)
def scalar_transforms(spark, folder):
    from emberframe.functions import scalar as S

    rows = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.col("o_custkey").cast("double")
    return rows.select(
        "o_orderkey",
        F.round(S.strict_log("o_totalprice"), 8).alias("log_"),
        F.round(S.log_plus_one("o_totalprice"), 8).alias("log_1"),
        F.round(S.log10("o_totalprice"), 8).alias("log10_"),
        F.round(S.log10_plus_one("o_totalprice"), 8).alias("log10_1"),
        F.round(S.square_root("o_totalprice"), 8).alias("root"),
        F.round(S.cube_root(F.col("o_totalprice") - 250000), 8).alias("cube_root"),
        S.square(key).alias("squared"),
        S.product(key, "o_orderkey").alias("product_"),
    )


@check(
    "SF8 SF9 SF10",
    with_sql(OBS, CELLS, REGIONS, BASE, monthly_sql("LAI"))
    + f"""SELECT {KEY}, "LAI" IS NULL AS absent, printf('%.5f', "LAI") AS printed,
  'F(' || "Year" || ',' || "Month" || ')' AS label FROM base LEFT JOIN m_LAI USING ({KEY})""",
)
def printed_values(spark, folder):
    rows = P.join_monthly(base_grid(spark, folder), monthly(spark, folder, "LAI"))
    return rows.select(
        "col", "row", "Year", "Month",
        is_missing("LAI").alias("absent"),
        F.when(F.col("LAI").isNotNull(), fixed_width("LAI", 5)).alias("printed"),
        joined_text(F.lit("F("), "Year", F.lit(","), "Month", F.lit(")")).alias("label"),
    )


@check(
    "AG1",
    with_sql(OBS, CELLS, REGIONS, BASE) + """SELECT "Year", count(*) AS "N" FROM base GROUP BY ALL""",
)
def rows_per_year(spark, folder):
    return count_by(base_grid(spark, folder), "Year")
