"""Ordered file stacks: the place of a file in its sorted folder is its layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import materialise


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def layer_names(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, layer): files of a folder and of the folders in it, by their own names, counted from 0; equal names by path.

    Only paths are listed, contents stay unread. The window has no partition
    key because it ranks file names, one per layer, never data rows. The names
    are written, so that the planner judges a join by their size, not by that
    of the files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path")
    )
    rank = F.row_number().over(Window.orderBy(file_name(F.col("path")), "path")) - 1
    return materialise(files.select("path", rank.cast("int").alias("layer")), "layer-names")


def with_layer(rows: DataFrame, layers: DataFrame, path: str = "path") -> DataFrame:
    """Attach the layer index; ``rows`` carries the file each row came from."""
    plain = F.regexp_replace(F.col(path), "^file:/+", "/")
    keyed = rows.withColumn(path, plain)
    names = layers.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return keyed.join(names.withColumnRenamed("path", path), path).drop(path)
