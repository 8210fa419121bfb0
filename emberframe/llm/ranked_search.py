"""Ranked lexical search by a pipeline of term owners.

The index is cut in two ways: documents into blocks of a few megabytes of text, and
terms among owners. A bundle of items with its accumulators for one block passes
through the owners one after another. At each it is grouped together (cogroup) with
the owner's postings of that block; the owner adds its terms' integer contributions
to the sparse accumulators, (document, score) for every item, and sends the bundle on. After the
last owner each bundle names its best documents, and the best of those are ranked.

A term that stands in every document is as many posting lists as there are blocks,
so neither it nor any group of documents lands in one task; the memory of a task is
bounded by a block and the items of one bundle. Nothing is pruned: all documents
with a score above 0 are in some accumulator until the last step.

Defined results: terms are runs of letters and digits of ASCII and of all other
characters, A-Z in lower case. Texts that are null or have no term count nowhere and
are never found; an item without terms finds nothing. Documents that repeat an id are
ranked one by one; those without an id count in the statistics and are not
returned. Items that repeat an id are ranked one by one. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, stored
from .word_runs import ascii_words
from .words import raw_bytes, slices

#: Owners that terms are dealt to, one stage each.
OWNERS = 4
#: Items that share a bundle.
BUNDLE = 256
#: Bytes of text in a block; a longer text stands alone.
BLOCK_BYTES = 4_000_000

# Terms, and the scale of contributions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, FULL, LENGTH_SHARE, SATURATION = 1_000_000_000, 100, 75, 8

IN_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

INDEX = "block long, owner int, term string, positions array<int>, numbers array<int>, ids array<long>"
BUNDLES = "block long, bundle int, ids array<long>, lengths array<long>, items array<long>, ends array<int>, positions array<int>, scores array<long>"


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of each text."""
    spaced = raw_bytes(texts).translate(IN_TERMS)
    width = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return ascii_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(spaced)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: posting lists (positions in the block, numbers of occurrences) by term and owner.

    The row without a term has the documents' ids and, as numbers, their terms with repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1), BLOCK_BYTES):
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                lists = term_lists(texts)
                first = lists.offsets.to_numpy().astype(np.int64)
                number = np.diff(first)
                coded = lists.values.dictionary_encode()
                kinds = len(coded.dictionary)
                owner = np.repeat(np.arange(len(texts)), number)
                held, occurs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + owner, return_counts=True)
                term, position = np.divmod(held, len(texts))
                ends = pa.array(np.searchsorted(term, np.arange(kinds + 1)), pa.int32())
                postings = [
                    pa.array(np.full(kinds, block)),
                    pa.nulls(kinds, pa.int32()),
                    coded.dictionary,
                    pa.ListArray.from_arrays(ends, pa.array(position, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(occurs, pa.int32())),
                    pa.nulls(kinds, pa.list_(pa.int64())),
                ]
                own = [
                    pa.array([block]),
                    pa.nulls(1, pa.int32()),
                    pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.array(number, pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids.cast(pa.int64())),
                ]
                for columns in (postings, own):
                    yield pa.RecordBatch.from_arrays(columns, ["block", "owner", "term", "positions", "numbers", "ids"])
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, INDEX).withColumn("owner", F.pmod(F.xxhash64("term"), F.lit(OWNERS)).cast("int"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item id) and (item, term, times); item numbers the rows, so that ids may repeat."""
    rows = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col), F.col(text_col).alias("text")), "search-items")
    terms = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return rows.select("item", id_col), rows.select("item", terms.alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def added(key: tuple, bundles: pa.Table, postings: pa.Table) -> pa.Table:
    """One owner's contributions to the accumulators of one bundle in one block."""
    if not bundles.num_rows or not postings.num_rows:
        return bundles
    lengths = bundles.column("lengths").combine_chunks().flatten().to_numpy()
    old_items, old_ends = (bundles.column(c).combine_chunks().flatten().to_pylist() for c in ("items", "ends"))
    before = {item: (a, b) for item, a, b in zip(old_items, old_ends, old_ends[1:])}
    old_positions = bundles.column("positions").combine_chunks().flatten().to_numpy()
    old_scores = bundles.column("scores").combine_chunks().flatten().to_numpy()
    totals: dict[int, np.ndarray] = {}
    takers = postings.column("takers").combine_chunks()
    for row in range(postings.num_rows):
        at = postings.column("positions")[row].values.to_numpy()
        number = postings.column("numbers")[row].values.to_numpy().astype(np.int64)
        share = SCALE * number // (1000 * number + SATURATION * lengths[at])
        for taker in takers[row].as_py():
            if taker["item"] not in totals:
                totals[taker["item"]] = np.zeros(len(lengths), np.int64)
            totals[taker["item"]][at] += taker["times"] * taker["weight"] * share
    items, ends, positions, scores = [], [0], [], []
    for item in sorted(totals.keys() | before.keys()):
        total = totals.get(item)
        a, b = before.get(item, (0, 0))
        if total is None:
            at, score = old_positions[a:b], old_scores[a:b]
        else:
            total[old_positions[a:b]] += old_scores[a:b]
            at = np.flatnonzero(total)
            score = total[at]
        items.append(item)
        ends.append(ends[-1] + len(at))
        positions.append(at)
        scores.append(score)

    def one(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    new = [one(np.array(items, np.int64), pa.int64()), one(np.array(ends), pa.int32())]
    new += [one(np.concatenate(positions), pa.int32()), one(np.concatenate(scores), pa.int64())]
    old = [bundles.column(c).combine_chunks() for c in ("block", "bundle", "ids", "lengths")]
    return pa.Table.from_arrays(old + new, ["block", "bundle", "ids", "lengths", "items", "ends", "positions", "scores"])


def best_of_blocks(bundles: DataFrame, most: int) -> DataFrame:
    """(item, id, score): the documents of each block that may be among the best of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                items, ends, positions, scores = (batch.column(c)[row].values.to_numpy() for c in range(1, 5))
                for i, item in enumerate(items.tolist()):
                    at, score = positions[ends[i] : ends[i + 1]], scores[ends[i] : ends[i + 1]]
                    ok = known[at] & (score > 0)
                    at, score = at[ok], score[ok]
                    if len(at) > most:
                        enough = score >= np.partition(score, len(score) - most)[len(score) - most]
                        at, score = at[enough], score[enough]
                    order = np.lexsort((ids[at], -score))[:most]
                    columns = [pa.array(np.full(len(order), item)), pa.array(ids[at[order]]), pa.array(score[order])]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return bundles.select("ids", "items", "ends", "positions", "scores").mapInArrow(run, "item long, id long, score long")


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms) from the blocks' rows of documents."""
    some = F.filter("numbers", lambda n: n > 0)
    total = F.aggregate("numbers", F.lit(0).cast("long"), lambda s, n: s + n)
    row = docs.agg(F.sum(F.size(some)).alias("n"), F.sum(total).alias("terms")).first()
    return int(row["n"] or 0), int(row["terms"] or 0)


def length_shares(n: int, terms: int) -> Column:
    """Each document's length against the mean, in hundredths, mixed with a whole."""
    return F.expr(f"transform(numbers, x -> {FULL - LENGTH_SHARE}L + ({LENGTH_SHARE}L * x * {n}L) div {max(terms, 1)}L)")


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the ``most`` best documents of each item."""
    blocks = stored(index(docs, id_col, text_col), "search-index")
    holders, lists = blocks.filter("term IS NULL"), blocks.filter("term IS NOT NULL")
    n, terms = statistics(holders)
    names, wanted = item_terms(items, item_col, item_text)
    n_bundles = -(-names.count() // BUNDLE)

    found = lists.join(wanted.select("term").distinct(), "term", "left_semi")
    df = stored(found.groupBy("term").agg(F.sum(F.size("positions")).alias("df")), "search-df")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    taker = F.struct("item", "times", weight.alias("weight"))
    bundle = F.pmod(F.xxhash64("item"), F.lit(max(1, n_bundles))).cast("int")
    takers = wanted.join(df, "term").groupBy("term", bundle.alias("bundle")).agg(F.collect_list(taker).alias("takers"))  # at most the items of a bundle
    takers = stored(takers, "search-takers")

    nothing = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("items", "long"), ("ends", "int"), ("positions", "int"), ("scores", "long"))]
    every = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_bundles - 1))))
    bundles = holders.select("block", every.alias("bundle"), "ids", length_shares(n, terms).alias("lengths"), *nothing)
    key = ["block", "bundle"]
    for owner in range(OWNERS):
        own = lists.filter(F.col("owner") == owner).select("block", "term", "positions", "numbers").join(takers, "term")
        own = own.select(*[F.col(c).alias(c) for c in ("block", "bundle", "positions", "numbers", "takers")])
        bundles = bundles.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(added, BUNDLES)
    best = stored(best_of_blocks(bundles, most), "search-best")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    top = best.withColumn("rank", place).filter(F.col("rank") <= most)
    return top.join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_SQL_TERMS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}'))"

OP13_SQL = f"""WITH occurrences AS (SELECT doc_id, {_SQL_TERMS} AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM occurrences GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000.0::DOUBLE * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SQL_TERMS} AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""
