"""Writing intermediate tables where every executor can read them back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="emberframe-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; on a cluster a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _test_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/emberframe-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps later passes
    columnar, so each reads only the columns it uses.
    """
    path = new_folder(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group keys, in which a missing key is a group like any other."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(named, same).drop(*[f"__{k}" for k in keys])
