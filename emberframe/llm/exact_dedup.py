"""Exact duplicates against a persistent index of digests.

Texts are equal when they agree after white space (space, tab to carriage
return) is deleted. The index is a table bucketed and sorted by digest: new
digests are found by a sort-merge anti-join with it and appended, so a later
batch compares with everything seen so far without reading old texts. Each digest
carries the batch that brought it, so a batch that is run again, after it was lost
between the append and its own results, finds its texts as new as the first time.

Defined results: a null text counts as empty; empty texts equal each other;
an id of null loses every tie; rows that repeat an id and an equal text are
rows of one document. Other columns play no part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_folder, stored

#: The characters that comparison leaves out.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256))


@dataclass
class DigestIndex:
    """A bucketed table (digest, keep_id, batch), one row for each digest seen."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new, empty index; ``buckets`` defaults to the session's shuffle partitions."""
        path = path or scratch_folder(spark, "digest-index")
        index = cls(spark, f"digest_index_{uuid.uuid4().hex}", path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(
            f"CREATE TABLE {index.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{path}'"
        )
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """An index that an earlier session wrote at ``path`` with ``buckets`` buckets."""
        return cls.create(spark, path, buckets)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def unseen(self, found: DataFrame) -> DataFrame:
        """Rows of ``found`` whose digest the index lacks."""
        return found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Add rows (digest, keep_id, batch); the caller has made sure that they are unseen."""
        (
            fresh.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars) of every row; chars counts code points of the original text."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_digest(F.col(text_col)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """(digest, best_id, best_rows, size): the longest original, then the smallest id.

    Both steps add up within each task first, so a digest that holds a third
    of the rows sends one row per task.
    """
    by_id = rows.groupBy("digest", "id").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().alias("without"), F.col("id"), F.col("n"))
    return (
        by_id.groupBy("digest")
        .agg(F.min(order).alias("best"), F.sum("n").alias("size"))
        .select("digest", F.col("best.id").alias("best_id"), F.col("best.n").alias("best_rows"), "size")
    )


def resolve(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Append what is new in ``docs``; return its rows and its groups.

    rows: (id, digest, chars); groups: (digest, keep_id, size, keep_rows), where
    keep_id is that of an earlier batch if one had the text, and keep_rows then 0.
    ``batch`` names these rows; a second run under the same name gives the same
    result. Without a name every run is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    rows = stored(digest_rows(docs, id_col, text_col), "digests")
    found = stored(groups(rows), "digest-groups")
    fresh = stored(index.unseen(found), "digest-fresh")
    index.append(fresh.withColumnRenamed("best_id", "keep_id").withColumn("batch", F.lit(batch)))
    is_new = F.col("batch") == F.lit(batch)
    kept = found.join(index.rows(), "digest").select("digest", "keep_id", "size", F.when(is_new, F.col("best_rows")).otherwise(F.lit(0)).alias("keep_rows"))
    return rows, stored(kept, "digest-kept")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    rows, kept = resolve(docs, index, id_col, text_col, batch)
    # Thin rows on either side; a digest with very many rows is split by the skew join.
    joined = rows.join(kept.hint("merge"), "digest")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("keep_rows") > 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, once each, with their own columns."""
    _, kept = resolve(docs, index, id_col, text_col, batch)
    names = docs.columns
    keep = kept.filter("keep_rows > 0").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("keep_rows").alias("__rows"))
    marked = docs.withColumn("__own", text_digest(F.col(text_col)))
    same = F.col("__own").eqNullSafe(F.col("__digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("__keep"))
    joined = marked.join(keep, same)
    once = joined.filter("__rows = 1")
    repeated = joined.filter("__rows > 1").dropDuplicates(["__own"])
    return once.unionByName(repeated).select(*names)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return exact_dedup(docs, DigestIndex.create(spark))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
