"""CSV and Parquet tables: scan by header name, write, and read-back check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a missing value is written in the CSV inputs.
MISSING_MARKS = ("NA", "")


def csv_table(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Read columns by header name, whatever their order in the file.

    Only the header line is looked at for the schema, so no inference pass.
    Files read together must agree on their header, or the read fails.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    absent = [c for c in columns if c not in raw.columns]
    if absent:
        raise ValueError(f"columns not in the header: {absent}")

    def typed(name: str, kind: str) -> Column:
        text = F.trim(F.col(name))
        return F.when(~text.isin(*MISSING_MARKS), text).cast(kind).alias(name)

    return raw.select(*[typed(n, k) for n, k in columns.items()])


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.partitionBy(*partition_by).csv(path, header=True, nullValue="NA")
    return path


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("Year",)) -> str:
    """Partitioning by Year lets a year filter skip whole folders."""
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def table_profile(df: DataFrame) -> DataFrame:
    """Row count and missing count per column, as (column, rows, missing)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(missing(df, c)).alias(c) for c in df.columns],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    return counts.select(F.col("__rows").alias("rows"), F.explode(pairs).alias("p")).select(
        "p.column", "rows", "p.missing"
    )


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def read_back_check(written: DataFrame, reread: DataFrame) -> DataFrame:
    """Row and missing counts of a table before and after writing, side by side."""
    before = table_profile(written).select("column", F.col("rows").alias("rows_written"), F.col("missing").alias("missing_written"))
    after = table_profile(reread).select("column", F.col("rows").alias("rows_read"), F.col("missing").alias("missing_read"))
    same = (F.col("rows_written") == F.col("rows_read")) & (F.col("missing_written") == F.col("missing_read"))
    return before.join(after, "column", "full").withColumn("same", F.coalesce(same, F.lit(False)))
