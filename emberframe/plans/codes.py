"""Code tables of the panel, as published for the source data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fire regions by code, 0 being sea.
REGIONS = (
    "Sea",
    "BONA",
    "TENA",
    "CEAM",
    "NHSA",
    "SHSA",
    "EURO",
    "MIDE",
    "NHAF",
    "SHAF",
    "BOAS",
    "CEAS",
    "SEAS",
    "EQAS",
    "AUST",
)

# Biomes by code, from 1.
BIOMES = (
    "Tropical and subtropical moist broadleaf forests",
    "Tropical and subtropical dry broadleaf forests",
    "Tropical and subtropical coniferous forests",
    "Temperate broadleaf and mixed forests",
    "Temperate Coniferous Forest",
    "Boreal forests / Taiga",
    "Tropical and subtropical grasslands, savannas and shrublands",
    "Temperate grasslands, savannas and shrublands",
    "Flooded grasslands and savannas",
    "Montane grasslands and shrublands",
    "Tundra",
    "Mediterranean Forests, woodlands and scrubs",
    "Deserts and xeric shrublands",
    "Mangroves",
)

# Labels of the land category.
INDIGENOUS, NOT_INDIGENOUS = "Indigenous Land", "None Indigenous Land"


def _code_table(spark: SparkSession, code: str, text: str, labels: tuple[str, ...], first: int) -> DataFrame:
    """Codes counted from ``first``; the planner knows the size and broadcasts it."""
    label = F.element_at(F.array(*[F.lit(t) for t in labels]), (F.col("id") + 1).cast("int"))
    return spark.range(len(labels)).select((F.col("id") + first).cast("int").alias(code), label.alias(text))


def region_codes(spark: SparkSession) -> DataFrame:
    return _code_table(spark, "Regions", "GFED_Regions_Desc", REGIONS, 0)


def biome_codes(spark: SparkSession) -> DataFrame:
    return _code_table(spark, "Biomes", "Biomes_Desc", BIOMES, 1)
