"""What the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Learning rows are those whose remainder differs from this one.
HELD_OUT_REMAINDER = 2
FOLDS = 4


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="emberframe-llm-")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session without that setting, as in a test, gets a folder of
    its own. A session that is not local must bring the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _test_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs the work
    since the last such table, and every later reader sees the same rows.
    """
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from; rows without an id count as false."""
    remainder = F.crc32(doc_id.cast("string")) % F.lit(FOLDS)
    return F.coalesce(remainder == F.lit(HELD_OUT_REMAINDER), F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows with an id that are not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def id_share(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone, for repeatable samples."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def drawn(text: Column, key: Column, pieces: int, size: int) -> Column:
    """A whole text of up to ``pieces`` times ``size`` characters; of a longer one so many pieces.

    The pieces lie anywhere in the text: a digest of the row's key and the piece's number
    chooses them. They keep their order, with a space between.
    """
    last = (F.ceil(F.length(text) / F.lit(size)) - 1).cast("int")
    lots = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64(key, k).alias("lot"), k.alias("k")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(lots), 1, pieces), lambda x: x["k"]))
    cut = F.array_join(F.transform(chosen, lambda k: F.substr(text, k * F.lit(size) + 1, F.lit(size))), " ")
    return F.when(F.length(text) <= pieces * size, text).otherwise(cut)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
