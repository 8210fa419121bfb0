"""Near copies by SimHash, met in the middle.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the
hashes of the text's word shingles. Two fingerprints link if at most three bits
differ. Each fingerprint emits its variants within half that radius, and two
that link have a variant in common:

- one or two differing bits: flip one bit on either side;
- three: the two fingerprints have bit counts of different parity. The even one
  flips two bits, the odd one flips the third. Two of any three bits lie in the
  same half of the word, so the even one flips pairs of one half only.

So odd fingerprints emit 65 variants and even ones 1,057, and a variant meets at
most that many. All texts with equal fingerprints are one class, which emits once.

Variants are dealt to tasks by their low bits. All variants of a fingerprint
with the same low bits travel as one row (low bits, fingerprint) and are spelled
out in the task, which sorts them. The low bits get more with the number of
fingerprints, and a deal that still holds too many variants, as of a large group of
near copies, is dealt again by eight more bits, at last by the whole variant.
Among those that meet at a variant, one that flipped at most one bit links with
all others, so a star around it keeps every link's two ends connected; a task
returns a spanning forest of its verified links, never all pairs of a group.

Defined results: words are what stands between white space (space, tab to carriage
return), A-Z in lower case; fewer words than a shingle has give one shingle; a null
text and one without words have fingerprint zero, which links like any other. Rows
that repeat an id each get a row; a row without an id gets the component of
its fingerprint, which is null if no row in it has an id. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .set_join import word_lists
from .shared import documents, stored
from .words import slices

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints that share their low bits, on average.
PER_DEAL = 2000
#: A deal with more variants is dealt again; tasks sort about so many at once.
MOST_VARIANTS = 4_000_000
#: Hashes whose bits are counted at once.
COUNTED = 100_000
HALVES = (0xFFFFFFFF, 0xFFFFFFFF00000000)


def shingle_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> list[int]:
    """XXH64 of the runs of n words; ``text`` has its words at starts and ends, one space apart."""
    if len(starts) >= n:
        spans = zip(starts[: len(starts) - n + 1].tolist(), ends[n - 1 :].tolist())
    else:
        spans = [(int(starts[0]), int(ends[-1]))] if len(starts) else []
    hashed = xxhash.xxh64_intdigest
    return [hashed(text[a:b], SEED) for a, b in spans]


def fingerprints(texts: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    words = word_lists(texts)
    ends_of_lists = words.offsets.to_numpy()
    width = pc.binary_length(words.values).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(width + 1) - 1  # in all words joined by single spaces
    starts = ends - width
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.values)], pa.int32()), words.values), " ")[0].as_buffer().to_pybytes()
    number = np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    for i, (a, b) in enumerate(zip(ends_of_lists[:-1].tolist(), ends_of_lists[1:].tolist())):
        own = shingle_hashes(joined, starts[a:b], ends[a:b], n)
        number[i] = len(own)
        hashes.append(np.array(own, "<u8"))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, "<u8")
    counts = np.zeros((len(texts), 64), np.int64)
    last = np.cumsum(number)
    for at in range(0, len(flat), COUNTED):
        part = flat[at : at + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = np.searchsorted(last, np.arange(at, at + len(part)), side="right")
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    set_bits = 2 * counts > number[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                own = fingerprints(texts, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(own)], ["id", "fp"])
                done += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def flips(even: bool) -> list[int]:
    """What a fingerprint of this parity may flip: nothing, a bit, and if even two bits of one half."""
    bits = [1 << i for i in range(64)]
    pairs = [bits[i] | bits[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return [0, *bits, *(pairs if even else [])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def low_mask(width: int) -> int:
    return (1 << width) - 1


def variants_left(width: int, even: bool, flipped: int) -> int:
    """Variants with one given way to flip the low bits."""
    return sum(m & low_mask(width) == flipped for m in flips(even))


def dealt(fps: DataFrame, width: int, within: int | None = None) -> DataFrame:
    """(deal, fp): the low bits of the variants of each fingerprint, once each.

    With ``within``, rows come as (deal, fp) dealt by so many bits, and each
    deal is divided by the further bits.
    """
    mask = low_mask(width)
    masks = [F.array(*[F.lit(signed(m)) for m in sorted({m & mask for m in flips(even)})]) for even in (False, True)]
    even = F.bit_count("fp") % 2 == 0
    deal = F.col("fp").bitwiseXOR(F.col("m")).bitwiseAND(F.lit(signed(mask)))
    old = [] if within is None else [F.col("deal").alias("old")]
    rows = fps.select("fp", *old, F.explode(F.when(even, masks[1]).otherwise(masks[0])).alias("m")).select("fp", *[c for c in ["old"] if old], deal.alias("deal"))
    if within is not None:
        rows = rows.filter(F.col("deal").bitwiseAND(F.lit(signed(low_mask(within)))) == F.col("old"))
    return rows.select("deal", "fp")


def weight(width: int) -> Column:
    """Variants that a row (deal, fp) stands for."""
    mask = low_mask(width)
    flipped = F.col("fp").bitwiseXOR(F.col("deal")).bitwiseAND(F.lit(signed(mask)))
    even = F.bit_count("fp") % 2 == 0
    out = F.lit(1)
    if width < 64:
        in_low = F.bit_count(flipped.bitwiseAND(F.lit(signed(HALVES[0]))))
        none = F.when(even, variants_left(width, True, 0)).otherwise(variants_left(width, False, 0))
        low = F.when(even, variants_left(width, True, 1)).otherwise(1)
        high = F.when(even, variants_left(width, True, 1 << 32) if width > 32 else 1).otherwise(1)
        out = F.when(flipped == 0, none).when(F.bit_count(flipped) == 1, F.when(in_low == 1, low).otherwise(high)).otherwise(out)
    return out.cast("long")


def spelled_out(fp: np.ndarray, deal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, row, inner) of all rows; inner: at most one bit was flipped."""
    mask = np.uint64(low_mask(width))
    flipped = (fp ^ deal) & mask
    even = np.bitwise_count(fp) % 2 == 0
    key = np.where(even, flipped, ~flipped)  # the same flips mean the same variants, by parity
    order = np.argsort(key, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every = {e: np.array(flips(e), np.uint64) for e in (False, True)}
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(rows):
            own = every[bool(even[rows[0]])]
            own = own[own & mask == flipped[rows[0]]]
            found.append(((fp[rows][:, None] ^ own).ravel(), np.repeat(rows, len(own)), np.tile(np.bitwise_count(own) <= 1, len(rows))))
    return tuple(np.concatenate(c) for c in zip(*found))


def star_links(variant: np.ndarray, row: np.ndarray, inner: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) as rows: at each variant, from one inner member to all others."""
    order = np.argsort(variant)
    variant = variant[order]
    same = variant[1:] == variant[:-1]
    shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    variant, row, inner = variant[shared], row[order[shared]], inner[order[shared]]
    if not len(variant):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate([[0], variant[1:] != variant[:-1]]))
    centre = np.full(group[-1] + 1, -1, np.int64)
    centre[group[inner][::-1]] = row[inner][::-1]
    a, b = centre[group], row
    ok = (a >= 0) & (a != b)
    a, b = a[ok], b[ok]
    close = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    return a[close], b[close]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components as the given edges among n nodes."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


def links_within(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(a, b): links between fingerprints found within each deal of ``rows``."""

    def solve(deal: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        names, place = np.unique(fp, return_inverse=True)
        variant, row, inner = spelled_out(fp, deal, width)
        a, b = forest(*star_links(variant, place[row], inner, names), len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[a].view(np.int64)), pa.array(names[b].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals, fps, weights, held = [], [], [], 0
        for batch in batches:
            deals.append(batch.column(0).to_numpy().view(np.uint64))
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            weights.append(batch.column(2).to_numpy())
            held += int(weights[-1].sum())
            if held < MOST_VARIANTS:
                continue
            deal, fp, number = np.concatenate(deals), np.concatenate(fps), np.concatenate(weights)
            # Whole deals only; the last one may go on in the next batch.
            ends = np.append(np.flatnonzero(deal[1:] != deal[:-1]) + 1, len(deal))
            at = 0
            while at < (last := ends[-2] if len(ends) > 1 else 0):
                upto = np.cumsum(number[at:last])
                fits = ends[(ends > at) & (ends <= at + np.searchsorted(upto, MOST_VARIANTS, side="right"))]
                stop = min(int(fits[-1] if len(fits) else ends[ends > at][0]), int(last))
                yield solve(deal[at:stop], fp[at:stop])
                at = stop
            deals, fps, weights = [deal[at:]], [fp[at:]], [number[at:]]
            held = int(weights[0].sum())
        if deals and sum(map(len, deals)):
            yield solve(np.concatenate(deals), np.concatenate(fps))

    whole = rows.repartition(parts, "deal").sortWithinPartitions("deal")
    return whole.select("deal", "fp", weight(width).alias("number")).mapInArrow(run, "a long, b long")


def linked(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever the links between the fingerprints of ``classes`` (fp, distinct) connect."""
    spark = classes.sparkSession
    n = classes.count()
    width = min(32, max(0, math.ceil(math.log2(max(1, n) / PER_DEAL)))) if n > PER_DEAL else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 100_000))
    rows = stored(dealt(classes.select("fp"), width), "simhash-deals")
    found = None
    while True:
        heavy = stored(rows.groupBy("deal").agg(F.sum(weight(width)).alias("number")).filter(F.col("number") > MOST_VARIANTS).select("deal"), "simhash-heavy")
        again = width < 64 and not heavy.isEmpty()
        light = rows.join(heavy, "deal", "left_anti") if again else rows
        links = stored(links_within(light, width, parts).distinct(), "simhash-links")
        found = links if found is None else found.union(links)
        if not again:
            return found
        deeper = min(64, width + 8)
        rows = stored(dealt(rows.join(heavy, "deal", "left_semi"), deeper, within=width), "simhash-deals")
        width = deeper


def simhash_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row: 16 hex digits, and the least id that links reach."""
    rows = stored(with_fingerprints(docs, id_col, text_col, n), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(linked(classes))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def op11_simhash_balls(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_join(documents(spark, folder))
