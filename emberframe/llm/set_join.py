"""Joining texts whose sets of word n-grams have a high Jaccard similarity.

Equal sets form one class first, so copies meet once. Classes are then joined
in two ways, by size. Two small sets reach the overlap they need exactly if
they share a subset of that size: all such subsets are enumerated and matched.
A pair with a large set is found through inverted lists of the first n-grams in
a global order (heavy ones last), which any similar pair must share. The size
that separates the two is the one with the least cost, from counted sizes and
list lengths.

Lists give pairs in two rounds. First every member of a list meets only the
list's first members, which joins a large group of near copies by about one
pair each. Then members that are still in different components meet each other.
Pairs that sizes, places in the lists or coarse counts rule out are left out,
all others are verified on the whole sets. No link that could join two
components is lost, but those inside one component need not all be verified.

Words are what stands between white space (space, tab to carriage return), A-Z
in lower case; an n-gram is known by a 64-bit hash. Defined results: a text
with fewer words than n has its whole sequence as one n-gram; a text that is
null or has no words has none and links with nothing; rows that repeat an id
count as one document; rows without an id link with nothing and get no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import documents, stored
from .words import slices

#: No set larger than this is enumerated, whatever the cost says.
MOST_SMALL = 40
#: An n-gram of so many texts among the first ones is heavy; at most HEAVY_KEPT
#: of them, the heaviest, are ordered last. Both change the work, not the result.
HEAVY_FROM, HEAVY_KEPT = 4, 2_000_000
#: Coarse counts of a set.
COUNTERS = 64
#: Members of a list that are compared as one block.
BLOCK = 2000
#: Ids are sent to all tasks only if there are at most so many.
FEW_IDS = 1_000_000


def least_overlap(a: int, b: int, percent: int) -> int:
    """Common elements that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def first_number(size: int, percent: int) -> int:
    """How many first elements of a set must hold one of any similar set."""
    return size - -(-percent * size // 100) + 1


def word_lists(texts: pa.Array) -> pa.ListArray:
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    filled = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values.filter(pa.array(filled)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    lists = word_lists(texts)
    coded = lists.values.dictionary_encode()
    by_word = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    words = by_word[coded.indices.to_numpy()]
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = mixed(rolled + np.uint64(0x9E3779B97F4A7C15)) + words[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    ends = lists.offsets.to_numpy().tolist()
    for a, b in zip(ends, ends[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.uint64([b - a])
            for w in words[a:b]:
                h = mixed(h + np.uint64(0x9E3779B97F4A7C15)) + w
            out.append(mixed(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def heavy_grams(docs: DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest n-grams among those that come first by hash, sorted, and their places by number, then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0)):
                firsts = [s[: first_number(len(s), percent) * 3 // 2 + 4] for s in gram_sets(texts, n)]
                grams, number = np.unique(np.concatenate(firsts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(number)], ["gram", "number"])

    counted = docs.select("text").mapInArrow(run, "gram long, number long").groupBy("gram").agg(F.sum("number").alias("number"))
    heavy = counted.filter(F.col("number") >= HEAVY_FROM).orderBy(F.desc("number"), "gram").limit(HEAVY_KEPT).toArrow()
    grams, number = heavy.column("gram").to_numpy().view(np.uint64), heavy.column("number").to_numpy()
    order = np.argsort(grams)
    place = np.empty(len(grams), np.int32)
    place[np.lexsort((grams[order], number[order]))] = np.arange(len(grams), dtype=np.int32)
    return grams[order], place


def summaries(docs: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, size, digest, firsts, whole, counts) of each text; whole: only of small sets."""
    heavy_of = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, place = heavy_of.value
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                rows: list[tuple] = []
                for grams in gram_sets(texts, n):
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
                        late = heavy[at] == grams
                        ordered = np.concatenate([grams[~late], grams[late][np.argsort(place[at[late]])]])
                    else:
                        ordered = grams
                    firsts = ordered[: first_number(len(grams), percent)] if len(grams) else grams
                    counts = np.bincount((grams >> np.uint64(3)) % np.uint64(COUNTERS), minlength=COUNTERS).astype("<u4")
                    rows.append(
                        (
                            len(grams),
                            hashlib.blake2b(grams.tobytes(), digest_size=16).digest(),
                            firsts.view(np.int64),
                            grams.view(np.int64) if len(grams) <= MOST_SMALL else None,
                            np.minimum(counts, 65535).astype("<u2").tobytes(),
                        )
                    )
                size, digest, firsts, whole, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        pa.array(size, pa.int32()),
                        pa.array(digest, pa.binary()),
                        pa.array(firsts, pa.list_(pa.int64())),
                        pa.array(whole, pa.list_(pa.int64())),
                        pa.array(counts, pa.binary()),
                    ],
                    ["id", "size", "digest", "firsts", "whole", "counts"],
                )
                done += len(texts)

    schema = "id long, size int, digest binary, firsts array<long>, whole array<long>, counts binary"
    return docs.mapInArrow(run, schema)


def subset_sizes(size: int, percent: int) -> list[int]:
    """Overlaps that a set of this size may need with a similar one."""
    partners = range(-(-percent * size // 100), 100 * size // percent + 1)
    return sorted({c for t in partners if (c := least_overlap(size, t, percent)) <= min(size, t)})


def subset_rows(size: int, percent: int) -> int:
    return sum(comb(size, c) for c in subset_sizes(size, percent))


def boundary(classes: DataFrame, percent: int) -> int:
    """The size below which sets are enumerated: the one with the least rows to read in all."""
    lists = classes.select("size", F.explode("firsts").alias("key"))
    length = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    some = lists.filter(F.col("size") <= MOST_SMALL)
    read = some.join(length, "key", "left").groupBy("size").agg(F.sum(F.coalesce("n", F.lit(1))).alias("read"))
    sizes = classes.filter(F.col("size") <= MOST_SMALL).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    by_size = {r["size"]: (r["n"], r["read"] or 0) for r in sizes.join(read, "size", "left").collect()}  # MOST_SMALL rows at most

    def cost(limit: int) -> int:
        return sum(n * subset_rows(s, percent) if s < limit else read for s, (n, read) in by_size.items())

    return min(range(1, MOST_SMALL + 2), key=lambda limit: (cost(limit), limit))


def postings(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """(key, k, size, at, light): subsets of sets below ``limit``, first elements of those that may meet a larger one."""

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, sizes = [], [], []
            for k, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = mixed(np.asarray(whole.values).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
                for c in subset_sizes(len(own), percent):
                    left_out = np.array(list(combinations(range(len(own)), len(own) - c)), np.int64).reshape(comb(len(own), c), len(own) - c)
                    found = mixed(own.sum() - own[left_out].sum(1, dtype=np.uint64) + np.uint64(c))
                    keys.append(found)
                    owners += [k] * len(found)
                    sizes += [len(own)] * len(found)
            if keys:
                columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners, pa.int64()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "k", "size"])

    small = classes.filter(F.col("size") < limit).select("k", "whole").mapInArrow(enumerate_subsets, "key long, k long, size int")
    least = F.lit(-(-percent * limit // 100))
    large = classes.filter(F.col("size") >= least).select("k", "size", F.posexplode("firsts").alias("at", "key"))
    return large.select("key", "k", "size", "at", F.lit(False).alias("light")).union(
        small.select("key", "k", "size", F.lit(0).alias("at"), F.lit(True).alias("light"))
    )


def may_link(x: str, y: str, limit: int, percent: int) -> Column:
    """What sizes and places in the lists allow; x, y: names of the rows."""
    sizes = (F.col(f"{x}.size"), F.col(f"{y}.size"))
    total, smaller, larger = sizes[0] + sizes[1], F.least(*sizes), F.greatest(*sizes)
    rest = F.least(sizes[0] - F.col(f"{x}.at"), sizes[1] - F.col(f"{y}.at"))
    by_list = (larger >= limit) & (rest * (100 + percent) >= total * percent)
    return (smaller * 100 >= larger * percent) & (F.col(f"{x}.light") | by_list)


def by_counts(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose coarse counts allow enough common elements."""
    coarse = classes.select("k", "size", "counts")
    rows = (
        pairs.join(coarse.select(F.col("k").alias("a"), F.col("size").alias("sa"), F.col("counts").alias("ca")), "a")
        .join(coarse.select(F.col("k").alias("b"), F.col("size").alias("sb"), F.col("counts").alias("cb")), "b")
        .select("a", "b", "sa", "sb", "ca", "cb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sa, sb = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(n, COUNTERS) for c in (4, 5))
                full = (ca == 65535).any(1) | (cb == 65535).any(1)
                common = np.minimum(ca, cb).sum(1, dtype=np.int64)
                ok = full | (common * (100 + percent) >= (sa + sb) * percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, judged on the whole sets of the texts that name the classes."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                sets = [s.tobytes() for s in gram_sets(texts, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(sets, pa.binary())], ["id", "grams"])
                done += len(texts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.searchsorted(u, v)
                common = int((u[np.minimum(at, len(u) - 1)] == v).sum()) if len(u) else 0
                ok.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = stored(docs.join(wanted, "id", "left_semi").mapInArrow(run, "id long, grams binary").dropDuplicates(["id"]), "near-sets")
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", "ga", "gb")
    )
    return stored(both.mapInArrow(judge, "a long, b long"), "near-links")


def pairs_within_lists(rows: DataFrame, limit: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of one list that are in different components and not ruled out.

    rows: (key, light, n, k, root, size, at, counts); n is the list's length.
    Lists longer than BLOCK are cut into blocks, and each two blocks are one
    unit of work, so that no task holds a whole long list. Units stand one
    after another in a sorted partition; only pairs that pass leave the task.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    unit = ["key", "light", "low", "high"]
    dealt = cut.repartition(*unit).sortWithinPartitions(*unit)
    dealt = dealt.select(*unit, "own", "k", "root", "size", "at", "counts")

    def compare(batch: pa.Table) -> pa.RecordBatch:
        n = batch.num_rows
        key, light, low, high, own, k, root, size, at = (batch.column(c).to_numpy() for c in range(9))
        counts = np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u2").reshape(n, COUNTERS)
        size, light = size.astype(np.int64), light.astype(bool)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (light[1:] != light[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        found = []
        left, step = np.arange(n), 1
        while len(left := left[left + step < ends[left]]):
            i, j = left, left + step
            total, smaller, larger = size[i] + size[j], np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            rest = np.minimum(size[i] - at[i], size[j] - at[j])
            ok = (root[i] != root[j]) & (smaller * 100 >= larger * percent) & ((low[i] == high[i]) | (own[i] != own[j]))
            ok &= light[i] | ((larger >= limit) & (rest * (100 + percent) >= total * percent))
            i, j, total = i[ok], j[ok], total[ok]
            if len(i):
                full = (counts[i] == 65535).any(1) | (counts[j] == 65535).any(1)
                common = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64)
                ok = full | (common * (100 + percent) >= total * percent)
                found.append(np.stack([np.minimum(k[i], k[j])[ok], np.maximum(k[i], k[j])[ok]]))
            step += 1
        both = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last unit may go on in the next batch.
            last = np.ones(table.num_rows, bool)
            for c in range(4):
                column = table.column(c).to_numpy()
                last &= column == column[-1]
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if first:
                yield compare(table.slice(0, first))
            held = table.slice(first)
        if held is not None:
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row: its set's size and the least id it can reach by links.

    Two documents link if 100 * common n-grams >= percent * n-grams in either.
    """
    texts = _texts(docs, id_col, text_col)
    found = stored(summaries(texts, n, percent, heavy_grams(texts, n, percent)), "gram-sets")
    classes = stored(
        found.filter("size > 0 AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("k"), *[F.first(c).alias(c) for c in ("size", "firsts", "whole", "counts")]),
        "gram-classes",
    )
    limit = boundary(classes, percent)
    rows = postings(classes, limit, percent)
    # Most n-grams stand in one set; the counts of all, two numbers each, leave the others' members to be shuffled and kept.
    several = rows.groupBy("key", "light").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(rows.join(stored(several, "near-keys"), ["key", "light"]), "near-members")
    heads = (
        members.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit((100 / percent) ** 2))))
        .groupBy("key", "light", "band")
        .agg(F.min(F.struct("k", "size", "at")).alias("first"))
    )
    heads = heads.groupBy("key", "light").agg(F.collect_set("first").alias("firsts"))
    # A list has few bands, so its heads are few; each member meets those its size allows.
    shared = members.join(heads, ["key", "light"])
    members = members.drop("n")
    led = shared.withColumn("y", F.explode("firsts")).select(F.struct("k", "size", "at", "light").alias("x"), "y")
    stars = led.filter("x.k <> y.k").filter(may_link("x", "y", limit, percent)).select(*ordered(F.col("x.k"), F.col("y.k"))).distinct()
    first_pairs = stored(by_counts(stars, classes, percent), "near-pairs")
    links = verified(first_pairs, texts, n, percent)
    joined = components(links)

    # Second round: members of one list that are still apart.
    placed = stored(members.join(joined.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")), "near-placed")
    apart = placed.groupBy("key", "light").agg((F.min("root") < F.max("root")).alias("apart"), F.count(F.lit(1)).alias("n")).filter("apart")
    open_rows = placed.join(apart.select("key", "light", "n"), ["key", "light"]).join(classes.select("k", "counts"), "k")
    second_pairs = stored(pairs_within_lists(open_rows, limit, percent).join(first_pairs, ["a", "b"], "left_anti"), "near-pairs")
    joined = components(links.union(verified(second_pairs, texts, n, percent)))

    roots = stored(
        classes.select("digest", "k").join(joined.withColumnRenamed("node", "k"), "k", "left").select("digest", F.coalesce("root", "k").alias("root")), "near-roots"
    )
    return found.select("id", "size", "digest").join(roots, "digest", "left").select(
        F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id")
    )


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return join_sets(documents(spark, folder))


#: Every two documents that share a shingle, counted; then whatever links reach.
OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i : i + 2], ' '))
  WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN z USING (doc_id) GROUP BY doc_id"""
