"""Token ids in ORC files.

Rows (doc_id, part, local_start, n_tokens, ids) are written in ascending order
of doc_id: ranges of ids go to tasks, each task sorts its range and writes one
file. ORC stores the ids as run-length encoded integers in stripes, keeps a
row index within each, and gets Bloom filters on doc_id. A reader therefore
splits files by stripes, skips stripes and row groups by id, and needs no other
file to find where a document starts: ``local_start`` counts the ids before it
in its part, and one small sum per part gives the rest.

Defined results: a null text is empty and holds the end id only; rows without
an id come first; rows of one id stand side by side, in no stated order unless
their texts differ, then in order of text.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PIECES, pieces_of
from .shared import documents, scratch_folder
from .words import RememberedRows, slices, split_words

#: Stands after the ids of each document.
END_ID = 1
# Fixed values of files that take words apart as ``bpe.pieces_of`` does.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, BYTES]}
#: Words or pieces that the library gets as one text.
WORDS_AT_ONCE = 200
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class LibraryEncoder:
    """Ids by the tokenizers library, which sees each word or piece again only after it was forgotten.

    Right for vocabularies whose pieces never span white space, such as those
    that drop it. Where a file takes words apart as ``bpe.pieces_of`` does, the
    library gets pieces, as words share them; otherwise it gets words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known = RememberedRows([pa.list_(pa.int32())])
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.of_parts = self.tokenizer
        if self.by_piece:  # pieces need neither be normalised nor taken apart
            self.of_parts = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": BYTES}))

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part_ids(self, parts: list[str]) -> tuple[list[str], list[pa.Array]]:
        mark, mark_id = next(iter(self.marks.items()))
        # A special token between parts keeps their ids apart; this call works out no offsets.
        joined = [mark.join(["", *parts[i : i + WORDS_AT_ONCE]]) for i in range(0, len(parts), WORDS_AT_ONCE)]
        lists = [e.ids for e in self.of_parts.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(lists), np.int32)
        # Of each part's ids the mark is the first.
        starts = np.append(np.flatnonzero(ids == mark_id), len(ids))
        ends = pa.array(starts - np.arange(len(starts)), pa.int32())
        return parts, [pa.ListArray.from_arrays(ends, pa.array(ids[ids != mark_id]))]

    def word_ids(self, words: list[str]) -> pa.ListArray:
        """The ids of each word."""
        opening = next(iter(self.marks))[:2]
        marked = [k for k, w in enumerate(words) if opening in w]
        plain = words.copy()
        for k in marked:
            plain[k] = ""
        parts, ends, places = pieces_of(plain) if self.by_piece else (plain, np.arange(len(plain) + 1), np.arange(len(plain)))
        rows = pa.array(self.known.rows(parts, self.part_ids))
        taken = self.known.columns[0].take(rows)
        by_word = pa.ListArray.from_arrays(taken.offsets.take(pa.array(ends)), taken.values)
        if marked:
            places[marked] = len(by_word) + np.arange(len(marked))
            by_word = pa.concat_arrays([by_word, pa.array([self.ids_of(words[k]) for k in marked], by_word.type)])
        return by_word.take(pa.array(places))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, with the end id."""
        split = split_words(texts)
        coded = split.values.dictionary_encode()
        taken = self.word_ids(coded.dictionary.to_pylist()).take(coded.indices)
        starts = taken.offsets.to_numpy()[split.offsets.to_numpy()]
        ids = np.insert(taken.values.to_numpy(), starts[1:], END_ID)
        return pa.ListArray.from_arrays(pa.array(starts + np.arange(len(starts)), pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the files to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary or default_vocabulary())
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                ids = encoder.encode(texts)
                n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), ids],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                done += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "10000")
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    files = spark.read.schema(SCHEMA).orc(path)
    parts = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each file that was written: as many as write tasks.
    return files.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


def documents_by_id(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of the given documents; other stripes and row groups are skipped by index and Bloom filter."""
    return read_ids(spark, path).filter(F.col("doc_id").isin(ids))


def with_checksum(rows: DataFrame) -> DataFrame:
    """Adds ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            at = (lists.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
            kept = [batch.column(n) for n in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "token-ids")
    write_ids(documents(spark, folder), path)
    return with_checksum(read_ids(spark, path))
