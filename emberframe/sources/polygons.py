"""GeoJSON polygons as one row per ring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polygon_rings(
    spark: SparkSession, path: str, attributes: dict[str, str], order: str, collection: bool = False
) -> DataFrame:
    """(feature, attributes..., ring) with ``ring`` an array of x, y structs.

    ``order`` names the attribute that numbers the features. The default
    layout is one feature per line, which splits across tasks; ``collection``
    reads a single FeatureCollection document.
    """
    fields = ", ".join(f"`{n}`: {t}" for n, t in attributes.items())
    properties, geometry = f"struct<{fields}>", "struct<type: string, coordinates: string>"
    if collection:
        schema = f"features array<struct<properties: {properties}, geometry: {geometry}>>"
        raw = spark.read.schema(schema).json(path, multiLine=True)
        raw = raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    else:
        raw = spark.read.schema(f"properties {properties}, geometry {geometry}").json(path)
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    return raw.select(
        F.col(f"properties.{order}").cast("bigint").alias("feature"),
        *[F.col(f"properties.{n}").alias(n) for n in attributes],
        F.explode(rings).alias("line"),
    ).select(
        "feature",
        *attributes,
        F.transform("line", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"),
    )
