"""Documents made ready for training, in five stages.

Each stage gets the documents that its predecessor kept, written as Parquet and
read again, and returns those that it keeps, with the columns of documents. The
last one returns their ids, token counts and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import bpe, decontamination, exact_dedup, language, set_join
from emberframe.llm.shared import documents, stored

#: Documents are near copies if they share so many percent of their runs of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without letters and those that no learned language claims."""
    return language.claimed_rows(docs, language.train(docs))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text stays: the longest, then the one with the smallest id."""
    return exact_dedup.without_copies(docs, exact_dedup.DigestIndex.create(spark))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links stays: the one with the smallest id."""
    groups = set_join.join_sets(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    dropped = stored(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "near-dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", in_a_language),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None
