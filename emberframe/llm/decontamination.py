"""Passages of a benchmark in documents, by fingerprints of item-sized windows.

Words are runs of letters and digits in lower case; shingles are five words
(of shorter items, all their words). Wherever a document shares a shingle with
an item, the window of the item's size that lines both up is fingerprinted: each
bit of a SimHash adds up the shingles' weights. Fingerprints are cut into BLOCKS
blocks, each an index entry (item, block, value). Fingerprints that differ in
RADIUS bits or fewer agree in BLOCKS - RADIUS blocks at least, so a window that
meets its item in as many entries is a candidate, and none within the radius is
lost. Two unrelated windows agree in a quarter of their blocks. Candidates are
verified by exact weighted similarity: the weights of common shingles over those
of all, rare shingles of the benchmark weighing more. From 0.8 on the document
holds the item. At 0.8 about 39 of 256 bits differ; 75 is more than five
standard deviations above (measured in the tests).

The windows left out share no shingle with the item, so their similarity is 0.

Everything is DataFrame functions. Defined results: a null text or item has no
words and matches nothing, as does an item without an id; items with equal words
each match, and of items that repeat an id the best match counts; of rows that
repeat an id each text is searched by itself, and the best match counts; a row
without an id is found under a missing id, and without_benchmark leaves out the
very rows that hold an item; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 256, 128, 75


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer words."""
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(size)]))


def simhash(hashes: Column, weights: Column) -> Column:
    """array<int> of BLOCKS block values of the weighted SimHash of shingles."""
    width = BITS // BLOCKS
    more = lambda h: F.array(h, *[F.xxhash64(h, F.lit(i)) for i in range(1, BITS // 64)])
    pairs = F.zip_with(hashes, weights, lambda h, w: F.struct(more(h).alias("h"), w.alias("w")))
    places = F.sequence(F.lit(0), F.lit(BITS - 1))

    def added(sums: Column, x: Column) -> Column:
        bit = lambda p: F.getbit(F.get(x["h"], F.shiftright(p, 6)), p.bitwiseAND(F.lit(63)))
        return F.transform(places, lambda p: F.get(sums, p) + F.when(bit(p) == 1, x["w"]).otherwise(-x["w"]))

    sums = F.aggregate(pairs, F.array_repeat(F.lit(0.0), BITS), added)
    bits = F.transform(sums, lambda v: (v > 0).cast("int"))
    one = lambda b: sum((F.get(b["bits"], b["at"] * width + i) * (1 << i) for i in range(width)), F.lit(0))
    # an array of one binds the bits, which would be worked out anew for each block
    return F.flatten(
        F.transform(
            F.array(bits), lambda own: F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda at: one({"bits": own, "at": at}))
        )
    )


def similarity(ours: Column, ours_weight: Column, theirs: Column, theirs_weight: Column) -> Column:
    """Weighted Jaccard similarity of two lists of distinct shingles."""

    def total(hashes: Column, weights: Column, also: Column | None = None) -> Column:
        rows = F.zip_with(hashes, weights, lambda h, w: F.struct(h.alias("h"), w.alias("w")))
        rows = F.filter(rows, lambda x: F.array_contains(also, x["h"])) if also is not None else rows
        return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x["w"])

    common = total(theirs, theirs_weight, ours)
    return common / (total(ours, ours_weight) + total(theirs, theirs_weight) - common)


def items_table(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """items: (row, item, n, k, hashes, weights, blocks); places: (hash, row, item, at, n, k) of each shingle.

    ``row`` tells apart items that repeat an id with different words.
    """
    tokens = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), words(F.col(text_col)).alias("tokens"))
    tokens = tokens.filter(F.size("tokens") > 0).dropDuplicates(["item", "tokens"])
    tokens = stored(tokens.select(F.monotonically_increasing_id().alias("row"), "item", "tokens", F.size("tokens").alias("n")), "benchmark-items")
    by_size = F.when(F.col("n") >= SHINGLE, shingles(F.col("tokens"), SHINGLE))
    for size in range(1, SHINGLE):
        by_size = by_size.when(F.col("n") == size, shingles(F.col("tokens"), size))
    rows = tokens.select("row", "item", "n", F.least("n", F.lit(SHINGLE)).alias("k"), by_size.alias("all"))
    places = stored(rows.select("row", "item", "n", "k", F.posexplode("all").alias("at", "hash")), "benchmark-shingles")
    weight = shingle_weights(places)
    weighted = (
        places.join(weight, "hash").groupBy("row", "item", "n", "k", "hash", "w").agg(F.min("at").alias("at"))
        .groupBy("row", "item", "n", "k").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "w"))).alias("s"))
    )
    items = weighted.select("row", "item", "n", "k", F.col("s.hash").alias("hashes"), F.col("s.w").alias("weights"))
    return stored(items.withColumn("blocks", simhash(F.col("hashes"), F.col("weights"))), "benchmark-prints"), places


def shingle_weights(places: DataFrame) -> DataFrame:
    """(hash, w): the fewer items hold a shingle, the more it weighs."""
    return places.groupBy("hash").agg(F.count_distinct("item").alias("f")).select("hash", (1 / F.log2(F.col("f") + 1.0)).alias("w"))


def windows(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(id, digest, row, start, n, k, hashes): item-sized windows where a text and an item line up, with distinct shingles.

    ``texts`` has (id, digest, text). A shingle that many items hold is as many
    rows, dealt by the planner.
    """
    sizes = [r[0] for r in places.select("k").distinct().collect()]  # SHINGLE values at most
    tokens = texts.select("id", "digest", words(F.col("text")).alias("tokens"))
    spots = stored(places.select("hash", "k", "row", "at", "n").distinct(), "benchmark-spots")
    known = spots.select("hash", "k").distinct()
    hits = None
    for size in sizes:
        runs = tokens.select("id", "digest", F.posexplode(shingles(F.col("tokens"), size)).alias("place", "hash")).withColumn("k", F.lit(size))
        found = runs.join(known, ["hash", "k"], "left_semi")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = tokens.select("id", "digest", F.lit(0).alias("place"), F.lit(0).cast("long").alias("hash"), F.lit(1).alias("k")).limit(0)
    start = F.greatest(F.lit(0), F.col("place") - F.col("at")).alias("start")
    lined_up = stored(hits, "benchmark-hits").join(spots, ["hash", "k"]).select("id", "digest", "row", "k", "n", start)
    lined_up = stored(lined_up.distinct(), "benchmark-starts")
    # Only texts with a hit are read again, for the words of their windows: their ids alone
    # meet all texts, so that these need not move while the ids are few.
    ids = stored(lined_up.select("digest").distinct(), "benchmark-ids")
    again = texts.join(ids, "digest", "left_semi").dropDuplicates(["id", "digest"])
    same = F.col("t.id").eqNullSafe(F.col("h.id")) & (F.col("t.digest") == F.col("h.digest"))
    per_text = lined_up.groupBy("id", "digest").agg(F.collect_list(F.struct("k", "n", "start", "row")).alias("hits"))
    cut = again.alias("t").join(per_text.alias("h"), same).select("t.id", "t.digest", words(F.col("t.text")).alias("tokens"), "h.hits")
    cut = cut.select("id", "digest", "tokens", F.explode("hits").alias("hit"))
    part = F.slice("tokens", F.col("hit.start") + 1, F.col("hit.n"))
    hashes = F.when(F.col("hit.k") == SHINGLE, shingles(part, SHINGLE))
    for size in range(1, SHINGLE):
        hashes = hashes.when(F.col("hit.k") == size, shingles(part, size))
    return cut.select("id", "digest", "hit.row", "hit.start", "hit.n", "hit.k", F.array_distinct(hashes).alias("hashes"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): the digest tells apart rows that repeat an id or have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("digest"), text.alias("text"))


def matches(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(id, digest, item, start, n, similarity) of every window that holds its item."""
    items, places = items_table(benchmark, item_col, item_text)
    found = stored(windows(texts, places), "benchmark-cuts")
    # A shingle that only the window holds weighs as one that no item holds.
    key = ["id", "digest", "row", "start", "n"]
    rows = found.select(*key, F.posexplode("hashes").alias("p", "hash"))
    weighed = (
        rows.join(shingle_weights(places), "hash", "left")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("p", "hash", F.coalesce("w", F.lit(1.0)).alias("w")))).alias("s"))
        .select(F.monotonically_increasing_id().alias("window"), *key, F.col("s.hash").alias("hashes"), F.col("s.w").alias("weights"))
    )
    prints = stored(weighed.withColumn("blocks", simhash(F.col("hashes"), F.col("weights"))), "benchmark-windows")
    entries = prints.select("window", "row", F.posexplode("blocks").alias("block", "value"))
    entries_of_items = items.select("row", F.posexplode("blocks").alias("block", "value"))
    agree = entries.join(entries_of_items, ["row", "block", "value"]).groupBy("window").agg(F.count(F.lit(1)).alias("agree"))
    candidates = agree.filter(F.col("agree") >= BLOCKS - RADIUS).select("window")
    theirs = items.select("row", "item", F.col("hashes").alias("item_hashes"), F.col("weights").alias("item_weights"))
    judged = prints.drop("blocks").join(candidates, "window").join(theirs, "row")
    same = similarity(F.col("hashes"), F.col("weights"), F.col("item_hashes"), F.col("item_weights"))
    return judged.withColumn("similarity", F.round(same, 9)).filter(F.col("similarity") >= SIMILARITY).select("id", "digest", "item", "start", "n", "similarity")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id_col, item_col, start, n_words, similarity): each document and item that match, at the first best window."""
    judged = matches(keyed(docs, id_col, text_col), benchmark, item_col, item_text)
    best = judged.groupBy("id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("best"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("best.start").cast("long").alias("start"),
        F.col("best.n").cast("long").alias("n_words"),
        (-F.col("best.s")).alias("similarity"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = matches(keyed(docs, id_col, text_col), benchmark, "item_id", "text")
    leaks = stored(found.select(F.col("digest").alias("_leak")).distinct(), "benchmark-leaks")
    digest = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(leaks, digest == F.col("_leak"), "left_anti")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _sql_runs(k: str, source: str, keep: str) -> str:
    return f"SELECT {keep}, unnest(range(0, len(tokens) - {k} + 1)) AS place, tokens FROM {source} WHERE len(tokens) >= {k}"


#: Every lined-up window judged by exact similarity, without fingerprints.
OP5_SQL = f"""WITH i AS (SELECT row_number() OVER () AS r, item, tokens, len(tokens) AS n, least(len(tokens), {SHINGLE}) AS k
  FROM (SELECT DISTINCT item_id AS item, {_SQL_WORDS} AS tokens FROM benchmark WHERE item_id IS NOT NULL) WHERE len(tokens) > 0),
places AS (SELECT r, item, n, k, place AS off, array_to_string(tokens[place + 1 : place + k], ' ') AS s FROM ({_sql_runs('k', 'i', 'r, item, n, k')})),
w AS (SELECT s, 1 / log2(count(DISTINCT item) + 1.0::DOUBLE) AS w FROM places GROUP BY s),
theirs AS (SELECT r, sum(w) AS theirs FROM (SELECT DISTINCT r, s FROM places) JOIN w USING (s) GROUP BY r),
d AS (SELECT DISTINCT doc_id, {_SQL_WORDS} AS tokens FROM documents),
runs AS (SELECT doc_id, tokens, k, place, array_to_string(tokens[place + 1 : place + k], ' ') AS s FROM ({' UNION ALL '.join(_sql_runs(str(k), 'd', f'doc_id, {k} AS k') for k in range(1, SHINGLE + 1))})),
hits AS (SELECT DISTINCT doc_id, tokens, r, k, n, greatest(0, place - off) AS start FROM runs JOIN places USING (k, s)),
cut AS (SELECT doc_id, r, k, n, start, tokens[start + 1 : start + n] AS tokens FROM hits),
parts AS (SELECT DISTINCT doc_id, r, k, n, start, tokens, array_to_string(tokens[place + 1 : place + k], ' ') AS s FROM ({_sql_runs('k', 'cut', 'doc_id, r, k, n, start')})),
judged AS (SELECT doc_id, r, n, start, sum(coalesce(w, 1)) AS ours, sum(CASE WHEN held.s IS NOT NULL THEN w ELSE 0 END) AS common
  FROM parts LEFT JOIN w USING (s) LEFT JOIN (SELECT DISTINCT r, s FROM places) held USING (r, s) GROUP BY doc_id, r, n, start, tokens),
scored AS (SELECT doc_id, item, start, judged.n, round(common / (ours + theirs - common), 9) AS similarity FROM judged JOIN theirs USING (r) JOIN i USING (r))
SELECT doc_id, item AS item_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words, similarity FROM scored WHERE similarity >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY similarity DESC, start, n) = 1"""
