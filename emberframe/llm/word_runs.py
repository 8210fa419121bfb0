"""Stretches of words that repeat with a period, found on a grammar of the text.

Re-Pair writes each text as a grammar: a pair of neighbouring symbols that occurs
three times or more, and more often than all pairs that it overlaps, becomes a
nonterminal, round after round. All texts of a slice go through a round together, as
arrays. (A pair that occurs only twice lies in no run, as a run has three periods.)
The symbols that remain are paired off as a balanced tree, so that every stretch of
words crosses the middle of the smallest node that covers it.

The runs that cross the middle of a node are computed once for each nonterminal, on
the place where it occurs first. Such a run leaves four equal words a period apart
at the middle, on the longer side of it; those places are looked up, and ranks of
word sequences of doubling length tell how far the period holds in either
direction, up to the ends of the node. The runs found are translated to every place
at which the nonterminal stands, and of the intervals of one period those that lie
in no other one are the text's runs.

Defined results: words are what stands between white space (space, tab to carriage
return), as written; a null text and one without words have no runs and an empty
collapsed text. Rows that repeat an id are worked on one by one; in a row without
an id no words are replaced. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .set_join import mixed
from .shared import documents
from .words import slices

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words at the middle of a node that must be equal a period apart: of a run of L words with
#: period q, one side has L/2 or more, and max(24, 3q)/2 - q is 4 or more for every q.
ANCHOR = 4
#: A pair of symbols becomes a nonterminal if it occurs so often.
LEAST_PAIRS = 3
#: Places that are compared at once.
COMPARED = 4_000_000


def ascii_words(texts: pa.Array) -> pa.ListArray:
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    filled = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values.filter(pa.array(filled)))


def planted(doc_ids: Sequence[int | None], n: np.ndarray) -> np.ndarray:
    """For each word, which word of its text stands there: the contract's repeated words for every tenth id."""
    first = np.concatenate([[0], np.cumsum(n)])
    source = np.arange(first[-1])
    for i, (doc_id, words) in enumerate(zip(doc_ids, n.tolist())):
        if doc_id is None or not words:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % words
            p = 1 + (words - a) // (3 + g % 8)
            source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(words - a) % p
    return source


def grammar(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Re-Pair of all texts: nonterminals as (start, middle, end), all places of each, places of the symbols that remain.

    ``codes`` names the words of each text apart from those of other texts. A
    nonterminal is given by the words at which it stands first. Texts without a
    nonterminal have no remaining symbols.
    """
    symbol, place, owner = codes.astype(np.int64), np.arange(len(codes)), text
    end = place + 1
    names = int(codes.max(initial=-1)) + 1
    rules: list[np.ndarray] = []
    places: list[np.ndarray] = []
    left: list[np.ndarray] = []
    written = np.zeros(int(text.max(initial=-1)) + 1, bool)
    while True:
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        # Of equal symbols in a row, every second pair counts.
        equal = symbol[pair] == symbol[pair + 1]
        goes_on = np.zeros(len(pair), bool)
        goes_on[1:] = equal[1:] & equal[:-1] & (pair[1:] == pair[:-1] + 1)
        since = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(pair))))
        pair = pair[(np.arange(len(pair)) - since) % 2 == 0]
        kinds, kind, number = np.unique(symbol[pair] * names + symbol[pair + 1], return_inverse=True, return_counts=True)
        often = number >= LEAST_PAIRS
        # Texts without a frequent pair are done.
        going = np.zeros(len(written), bool)
        going[owner[pair[often[kind]]]] = True
        rest = ~going[owner]
        left.append(place[rest & written[owner]])
        if not going.any():
            break
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed(kinds.view(np.uint64)), number))] = np.arange(len(kinds))
        near = np.flatnonzero((pair[1:] == pair[:-1] + 1) & (kind[1:] != kind[:-1]))
        x, y = kind[near], kind[near + 1]
        chosen = often.copy()
        chosen[np.where(rank[x] < rank[y], x, y)] = False
        hit = chosen[kind]
        at, kind = pair[hit], kind[hit]
        order = np.argsort(kind, kind="stable")
        at, kind = at[order], kind[order]
        fresh = np.concatenate([[True], kind[1:] != kind[:-1]])
        first = np.flatnonzero(fresh)
        rules.append(np.stack([place[at[first]], place[at[first] + 1], end[at[first] + 1]]))
        places += np.split(place[at], first[1:])
        symbol[at] = names + np.cumsum(fresh) - 1
        names += len(first)
        end[at] = end[at + 1]
        written[owner[at]] = True
        kept = ~rest
        kept[at + 1] = False
        symbol, place, end, owner = symbol[kept], place[kept], end[kept], owner[kept]
    return np.concatenate([np.zeros((3, 0), np.int64), *rules], axis=1), places, np.sort(np.concatenate(left))


def paired_off(bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Nodes (start, middle, end) of a balanced tree over the symbols of each text, given by their bounds in order."""
    nodes = [np.zeros((3, 0), np.int64)]
    while len(bounds):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(bounds)))
        at = np.arange(len(bounds)) - np.repeat(first, size)
        last = at == np.repeat(size, size) - 1
        low = np.flatnonzero((at % 2 == 0) & (at + 2 < np.repeat(size, size)))
        if not len(low):
            break
        nodes.append(np.stack([bounds[low], bounds[low + 1], bounds[low + 2]]))
        kept = (at % 2 == 0) | last
        bounds, owner = bounds[kept], owner[kept]
    return np.concatenate(nodes, axis=1)


class Sequences:
    """Equal stretches of words, by ranks of the stretches of length 1, 2, 4, ...

    A stretch that occurs once, or goes beyond its text, has rank -1 and equals none.
    """

    def __init__(self, codes: np.ndarray, text_end: np.ndarray):
        self.n = len(codes)
        self.ranks = [codes.astype(np.int64)]
        while True:
            width, before = 1 << (len(self.ranks) - 1), self.ranks[-1]
            at = np.flatnonzero((before >= 0) & (np.arange(self.n) + 2 * width <= text_end))
            at = at[before[at + width] >= 0]
            _, rank, number = np.unique(before[at] * (self.n + 1) + before[at + width], return_inverse=True, return_counts=True)
            again = number[rank] > 1
            if not again.any():
                break
            self.ranks.append(np.full(self.n, -1, np.int64))
            self.ranks[-1][at[again]] = rank[again]

    def of_anchors(self) -> np.ndarray:
        """Ranks of the stretches of ANCHOR words."""
        level = ANCHOR.bit_length() - 1
        return self.ranks[level] if level < len(self.ranks) else np.full(self.n, -1, np.int64)

    def equal_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = np.minimum(i + found, self.n - 1), np.minimum(j + found, self.n - 1)
            r = self.ranks[level]
            found += ((r[a] == r[b]) & (r[a] >= 0) & (j + found < self.n)).astype(np.int64) << level
        return found

    def equal_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i - found - (1 << level), j - found - (1 << level)
            r = self.ranks[level]
            found += ((a >= 0) & (r[a] == r[b]) & (r[a] >= 0)).astype(np.int64) << level
        return found


def crossing(nodes: np.ndarray, words: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs that cross the middle of a node, as far as they lie in it."""
    start, middle, end = nodes
    anchor, n = words.of_anchors(), words.n
    known = np.flatnonzero(anchor >= 0)
    key = np.sort(anchor[known] * n + known)
    most = (end - start) // LEAST_PERIODS

    def looked_up(of: np.ndarray, low: np.ndarray, high: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges in ``key`` of the places low..high with the anchor of ``of``."""
        rank = np.where(ok, anchor[np.clip(of, 0, n - 1)], -1)
        ok = ok & (rank >= 0) & (low <= high)
        a = np.searchsorted(key, rank * n + low)
        b = np.searchsorted(key, rank * n + high, side="right")
        return a, np.where(ok, b - a, 0)

    wide = end - start >= LEAST_WORDS
    right = looked_up(middle, middle + 1, np.minimum(end - ANCHOR, middle + most), wide)
    back = middle - ANCHOR
    left = looked_up(back, np.maximum(start, back - most), back - 1, wide & (back >= start))
    found = [np.zeros((4, 0), np.int64)]
    for (first, number), to_right in ((right, True), (left, False)):
        some = np.flatnonzero(number)
        upto = np.cumsum(number[some])
        for part in np.split(some, np.searchsorted(upto, np.arange(COMPARED, upto[-1] if len(upto) else 0, COMPARED))):
            if not len(part):
                continue
            node = np.repeat(part, number[part])
            step = np.arange(len(node)) - np.repeat(np.cumsum(number[part]) - number[part], number[part])
            other = key[first[node] + step] % n
            period = other - middle[node] if to_right else back[node] - other
            i = middle[node] if to_right else middle[node] - period
            a = np.maximum(start[node], i - words.equal_before(i, i + period))
            b = np.minimum(end[node], i + period + words.equal_after(i, i + period))
            ok = b - a >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([node, a, b, period])[:, ok])
    node, a, b, period = np.concatenate(found, axis=1)
    # One stretch also has the multiples of its period.
    order = np.lexsort((period, b, a, node))
    node, a, b, period = node[order], a[order], b[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return node[new], a[new], b[new], period[new]


def outermost(start: np.ndarray, end: np.ndarray, period: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which intervals lie in no other one of the same text and period; equal ones count once. By text, start, period."""
    order = np.lexsort((-end, start, period, text))
    group = np.cumsum(np.concatenate([[0], (text[order][1:] != text[order][:-1]) | (period[order][1:] != period[order][:-1])]))[: len(order)]
    reach = group * (int(end.max(initial=0)) + 1) + end[order]
    kept = np.ones(len(order), bool)
    kept[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    order = order[kept]
    return order[np.lexsort((period[order], start[order], text[order]))]


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs; ``words`` are numbers, and text i has those from first[i] to first[i + 1]."""
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    able = (size >= LEAST_WORDS)[text]
    origin, text = np.flatnonzero(able), text[able]
    none = np.zeros(0, np.int64)
    if not len(origin):
        return none, none, none, none
    _, codes = np.unique(text * (int(words.max()) + 1) + words[origin], return_inverse=True)
    rules, places, left = grammar(codes, text)
    if not len(places):
        return none, none, none, none
    # Only texts with nonterminals go on; their words get new places.
    written = np.zeros(len(size), bool)
    written[text[left]] = True
    kept = written[text]
    moved = np.append(np.cumsum(kept) - kept, kept.sum())
    codes, text, origin = codes[kept], text[kept], origin[kept]
    rules, left, places = moved[rules], moved[left], [moved[p] for p in places]
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))
    text_end = ends[np.searchsorted(ends, np.arange(len(text)), side="right")]
    bounds, owner = np.concatenate([left, ends]), np.concatenate([text[left], text[ends - 1]])
    order = np.lexsort((bounds, owner))
    top = paired_off(bounds[order], owner[order])
    node, a, b, period = crossing(np.concatenate([rules, top], axis=1), Sequences(codes, text_end))
    # To all places of the nonterminal; a node of the tree has one.
    number = np.array([len(p) for p in places] + [1] * top.shape[1])
    where = np.concatenate([*places, top[0]])
    begin = np.cumsum(number) - number
    row = np.repeat(np.arange(len(node)), number[node])
    step = np.arange(len(row)) - np.repeat(np.cumsum(number[node]) - number[node], number[node])
    shift = where[begin[node[row]] + step] - np.concatenate([rules[0], top[0]])[node[row]]
    a, b, period = a[row] + shift, b[row] + shift, period[row]
    kept = outermost(a, b, period, text[a])
    a, b, period = a[kept], b[kept], period[kept]
    return text[a], origin[a] - first[text[a]], b - a, period


Arrange = Callable[[Sequence[int | None], np.ndarray], np.ndarray]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Arrange | None = None) -> DataFrame:
    """(id_col, runs, collapsed) for each row.

    runs: array of (start, length, period), by start, then period, in words from
    0. collapsed: the words that are in no run after its first period, joined by one
    space. ``arrange(ids, word counts)`` may say which word stands in each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                lists = ascii_words(texts)
                first = lists.offsets.to_numpy().astype(np.int64)
                words = lists.values.dictionary_encode()
                source = np.arange(len(words)) if arrange is None else arrange(ids.to_pylist(), np.diff(first))
                text, start, length, period = runs_of(words.indices.to_numpy()[source], first)
                ends = np.searchsorted(text, np.arange(len(texts) + 1))
                found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, first[text] + start + period, 1)
                np.add.at(change, first[text] + start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                upto = np.concatenate([[0], np.cumsum(kept)])[first]
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists.values.take(pa.array(source[kept]))), " ")
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), collapsed], ["id", "runs", "collapsed"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = find_runs(documents(spark, folder), arrange=planted)

    def stronger(x: Column, y: Column) -> Column:
        """Less than 0 if x has the greater length by period, or the same and stands before y."""
        by_size = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(by_size != 0, by_size).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])

    best = F.get(F.array_sort("runs", lambda x, y: F.signum(stronger(x, y)).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    printed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(printed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
