"""ASCII grids: a short text header followed by rows of numbers.

A file may be cut into many splits. A first read counts the numbers of each split,
and their running sum over a file says at which number a split begins. The second read
numbers the values inside each split; together they give the cell. Lines need not be
rows of the grid, and no file has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import materialise

# Header keywords of the format, in lower case.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")
_HEADER_LINE = rf"(?i)^\s*({'|'.join(HEADER)})\s+(\S+)\s*$"


def grid_headers(lines: DataFrame) -> DataFrame:
    """(path, ncols, nrows, xll, yll, cellsize, nodata) of each file; corners are given or half a cell from centres."""
    found = lines.select("path", F.lower(F.regexp_extract("value", _HEADER_LINE, 1)).alias("name"), F.regexp_extract("value", _HEADER_LINE, 2).alias("word"))
    found = found.where("name <> ''").select("path", "name", F.expr("try_cast(word AS DOUBLE)").alias("number"))
    wide = found.groupBy("path").agg(*[F.max(F.when(F.col("name") == h, F.col("number"))).alias(h) for h in HEADER])

    def corner(axis: str) -> Column:
        return F.coalesce(F.col(f"{axis}corner"), F.col(f"{axis}center") - F.col("cellsize") / 2)

    return wide.select(
        "path",
        F.col("ncols").cast("int").alias("ncols"),
        F.col("nrows").cast("int").alias("nrows"),
        corner("xll").alias("xll"),
        corner("yll").alias("yll"),
        "cellsize",
        F.col("nodata_value").alias("nodata"),
    )


def _numbered(batches: Iterator) -> Iterator:
    """(path, block, place, value): the numbers of each split, counted in the order in which the task reads them."""
    import re

    import numpy as np
    import pyarrow as pa

    header = re.compile(_HEADER_LINE)
    split, seen = None, 0
    for batch in batches:
        paths, blocks, lines = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        while start < len(lines):
            stop = start
            while stop < len(lines) and (paths[stop], blocks[stop]) == (paths[start], blocks[start]):
                stop += 1
            if (paths[start], blocks[start]) != split:
                split, seen = (paths[start], blocks[start]), 0
            words = " ".join(line for line in lines[start:stop] if not header.match(line)).split()
            values = pa.array(np.array(words, float))
            place = pa.array(np.arange(seen, seen + len(words)))
            seen += len(words)
            names = [pa.array([v] * len(words), t) for v, t in zip(split, (pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*names, place, values], ["path", "block", "place", "value"])
            start = stop


def ascii_grids(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, ncols, nrows, xll, yll, cellsize, col, row, x, y, value), empty cells dropped."""
    lines = spark.read.text(paths, pathGlobFilter=pattern, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    words = F.when(F.col("value").rlike(_HEADER_LINE) | (F.trim("value") == ""), 0).otherwise(F.size(F.split(F.trim(F.translate("value", "\t\r", "  ")), " +")))
    counts = lines.groupBy("path", "block").agg(F.sum(words).alias("n"))  # one row per split
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("first"))
    splits = materialise(begins.join(grid_headers(lines), "path"), "grid-splits")
    values = lines.mapInArrow(_numbered, "path string, block long, place long, value double").join(splits, ["path", "block"])
    position = F.col("first") + F.col("place")
    return (
        values.withColumn("value", F.nullif(F.col("value"), F.col("nodata")))
        .where("value is not null AND NOT isnan(value)")
        .select(
            "path",
            "ncols",
            "nrows",
            "xll",
            "yll",
            "cellsize",
            F.pmod(position, F.col("ncols")).cast("int").alias("col"),
            F.floor(position / F.col("ncols")).cast("int").alias("row"),
            "value",
        )
        .withColumn("x", F.col("xll") + (F.col("col") + 0.5) * F.col("cellsize"))
        .withColumn("y", F.col("yll") + (F.col("nrows") - F.col("row") - 0.5) * F.col("cellsize"))
    )
