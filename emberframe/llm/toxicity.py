"""Toxicity of a text by a bidirectional gated recurrent network, in numpy.

A text is a sequence of words, scored in windows that overlap by a quarter. Each
word enters the network with word and character inputs: for both, evidence
(log odds of the hashed word, and of its hashed 3- to 5-grams) and a small
embedding that training adjusts. Two gated recurrent units read the window in
either direction, attention pools their states, and a logistic unit gives the
window's score; a text scores as its highest window, since one passage is enough.

Training uses a bounded sample of labelled rows, a label per text only: of each
toxic text the window that scores highest is learned as toxic, of clean texts
both random and highest ones as clean. At scoring, the input weights are applied
once per distinct word, so that a window costs only its recurrent steps.

Letters count in lower case. Defined results: a text that is null, empty or
without words holds no toxic passage and scores 0; rows with equal texts score equally
(to seven digits, as sums are in single precision);
extra columns play no part; with no toxic or no clean learning rows every text
scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, drawn, held_out, id_share, may_learn
from .words import Remembered, slices

#: Learning rows of either label, at most.
SAMPLE_ROWS = 2500
#: A learning text of up to 32 * 500 characters is learned whole, of a longer one so many pieces from all over it.
PIECES, PIECE = 32, 500
WINDOW, STRIDE = 32, 24
HIDDEN, EMBEDDED, ATTENDED = 6, 4, 6
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 20  # of evidence
EMBEDDINGS = 1 << 13  # for words, and for grams; buckets share them
GRAMS = (3, 4, 5)
STEPS, BATCH, RATE = 300, 480, 0.02
EVIDENCE_FOLDS = 3
EMBEDDING_RATE = 0.02  # of RATE; few texts hold any one word, so these learn slowly
#: Learning words that are hashed or given inputs at once; a bound on memory that changes no result.
WORDS_AT_ONCE = 1 << 13
#: From this score on a text counts as toxic.
THRESHOLD = 0.3


def tokens(texts: pa.Array) -> pa.ListArray:
    """Runs of letters and digits of each text, in lower case."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    return pa.ListArray.from_arrays(lists.offsets, lists.values)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; gram buckets of all words, and where each word's grams begin.

    Words stand one after another between marks, so that every word has a gram.
    """
    joined = "".join([f"<{w}>>" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 3
    first = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    rolled = codes * np.uint64(0x9E3779B97F4A7C15)
    buckets, owners = [], []
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[n - 1 :]
        if n in GRAMS:
            mixed = rolled ^ (rolled >> np.uint64(31))
            inside = owner[: len(mixed)] == owner[n - 1 :]
            buckets.append((mixed[inside] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(GRAM_BUCKETS))
            owners.append(owner[: len(mixed)][inside])
    flat, of = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(words)))
    powers = (codes + np.uint64(0x51)) * (owner_position(length) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019))
    whole = np.add.reduceat(powers ^ (powers >> np.uint64(29)), first)
    word_buckets = ((whole * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)) % np.uint64(WORD_BUCKETS)
    return word_buckets.astype(np.int64), flat[order], starts


def hashed_in_blocks(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``hashed``, with the steps of one block of words at a time in memory."""
    parts = []
    for a in range(0, len(words), WORDS_AT_ONCE):
        word, grams, starts = hashed(words[a : a + WORDS_AT_ONCE])
        parts.append((word.astype(np.int32), grams.astype(np.int32), starts))
    before = np.cumsum([0, *[len(grams) for _, grams, _ in parts]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + n for p, n in zip(parts, before)])


def owner_position(length: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each word."""
    first = np.cumsum(length) - length
    return (np.arange(int(length.sum())) - np.repeat(first, length)).astype(np.uint64) + np.uint64(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(length: int) -> list[int]:
    """First words of the windows that cover a text."""
    return list(range(0, max(1, length - WINDOW + STRIDE), STRIDE)) if length > WINDOW else [0]


@dataclass
class Network:
    """Parameters by name; evidence tables are fixed, the rest is trained."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    p: dict[str, np.ndarray]

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vector of each word, and what its gradient needs."""
        word, grams, starts = hashed(words)
        odds = self.gram_odds[grams]
        number = np.diff(np.append(starts, len(grams)))[:, None]
        embedded = np.add.reduceat(self.p["grams"][grams % EMBEDDINGS], starts, axis=0) / number
        evidence = np.stack([self.word_odds[word], np.maximum.reduceat(odds, starts), np.add.reduceat(odds, starts) / number[:, 0]], 1)
        x = np.concatenate([evidence, self.p["words"][word % EMBEDDINGS], embedded], 1).astype(np.float32)
        return x, (word % EMBEDDINGS, grams % EMBEDDINGS, number)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates in both directions: (words, 2, 3 * HIDDEN)."""
        return np.stack([x @ self.p[f"in{d}"] + self.p[f"bias{d}"] for d in (0, 1)], 1)

    def forward(self, gates: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores (as log odds) of windows; gates: (windows, steps, 2, 3 * HIDDEN)."""
        n, steps = present.shape
        states = np.zeros((2, steps + 1, n, HIDDEN), np.float32)
        kept = {"z": np.zeros((2, steps, n, HIDDEN), np.float32)}
        kept["r"], kept["c"], kept["u"] = (np.zeros_like(kept["z"]) for _ in range(3))
        for d in (0, 1):
            loop = self.p[f"loop{d}"]
            h = states[d, 0]
            for k in range(steps):
                t = k if d == 0 else steps - 1 - k
                g, mask = gates[:, t, d], present[:, t, None]
                inner = h @ loop
                z = sigmoid(g[:, :HIDDEN] + inner[:, :HIDDEN])
                r = sigmoid(g[:, HIDDEN : 2 * HIDDEN] + inner[:, HIDDEN : 2 * HIDDEN])
                u = inner[:, 2 * HIDDEN :]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u)
                h = h + mask * z * (c - h)
                states[d, k + 1] = h
                kept["z"][d, k], kept["r"][d, k], kept["c"][d, k], kept["u"][d, k] = z, r, c, u
        both = np.concatenate([states[0, 1:], states[1, :0:-1]], 2)  # (steps, windows, 2 * HIDDEN)
        seen = np.tanh(both @ self.p["look"] + self.p["look_bias"])
        weight = seen @ self.p["ask"]
        weight = np.where(present.T > 0, weight, -30)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        kept |= {"states": states, "both": both, "seen": seen, "weight": weight, "pooled": pooled}
        return logit, kept

    def backward(self, gates: np.ndarray, present: np.ndarray, kept: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of the gates."""
        p, steps = self.p, present.shape[1]
        both, seen, weight = kept["both"], kept["seen"], kept["weight"]
        g = {"out": kept["pooled"].T @ dlogit, "out_bias": np.array([dlogit.sum()])}
        dpooled = dlogit[:, None] * p["out"]
        dboth = weight[:, :, None] * dpooled
        dweight = (both * dpooled).sum(2)
        dask = weight * (dweight - (weight * dweight).sum(0))
        g["ask"] = np.einsum("tna,tn->a", seen, dask)
        dseen = dask[:, :, None] * p["ask"] * (1 - seen**2)
        g["look"] = np.einsum("tnh,tna->ha", both, dseen)
        g["look_bias"] = dseen.sum((0, 1))
        dboth = dboth + dseen @ p["look"].T
        dgates = np.zeros_like(gates)
        for d in (0, 1):
            loop, dh = p[f"loop{d}"], np.zeros((len(dlogit), HIDDEN), np.float32)
            dloop = np.zeros_like(loop)
            for k in range(steps - 1, -1, -1):
                t = k if d == 0 else steps - 1 - k
                dh = dh + dboth[t][:, d * HIDDEN : (d + 1) * HIDDEN]
                h, mask = kept["states"][d, k], present[:, t, None]
                z, r, c, u = (kept[x][d, k] for x in "zrcu")
                dz = dh * mask * (c - h) * z * (1 - z)
                dc = dh * mask * z * (1 - c**2)
                dr = dc * u * r * (1 - r)
                dinner = np.concatenate([dz, dr, dc * r], 1)
                dgates[:, t, d] = np.concatenate([dz, dr, dc], 1)
                dloop += h.T @ dinner
                dh = dh * (1 - mask * z) + dinner @ loop.T
            g[f"loop{d}"] = dloop
        return g, dgates


def new_network(word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    width = 3 + 2 * EMBEDDED

    def small(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {k: small(EMBEDDINGS, EMBEDDED, scale=0.02) for k in ("words", "grams")}
    for d in (0, 1):
        p[f"in{d}"] = small(width, 3 * HIDDEN, scale=width**-0.5)
        p[f"loop{d}"] = small(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        p[f"bias{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p["look"], p["look_bias"] = small(2 * HIDDEN, ATTENDED, scale=0.25), np.zeros(ATTENDED, np.float32)
    p["ask"], p["out"], p["out_bias"] = small(ATTENDED, scale=0.35), small(2 * HIDDEN, scale=0.25), np.zeros(1, np.float32)
    return Network(word_odds, gram_odds, p)


def evidence(toxic: np.ndarray, of_toxic: int, clean: np.ndarray, of_clean: int) -> np.ndarray:
    """Log odds that a text with a bucket is toxic, less two standard errors, not below 0."""
    odds = np.log((toxic + 0.5) / (of_toxic + 1)) - np.log((clean + 0.5) / (of_clean + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.clip(odds - 2 * error, 0, 5).astype(np.float32)


@dataclass
class Sample:
    """Learning texts as word numbers, with all that depends on words worked out once."""

    words: list[str]
    texts: list[np.ndarray]
    labels: np.ndarray


def sample_of(texts: list[str], labels: list[int]) -> Sample:
    lists = tokens(pa.array(texts, pa.string()))
    coded = lists.values.dictionary_encode()
    numbers, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
    words = coded.dictionary.to_pylist()
    return Sample(words, [numbers[a:b] for a, b in zip(ends, ends[1:])], np.array(labels))


def train_network(sample: Sample, seed: int = 7) -> Network:
    word, grams, starts = hashed_in_blocks(sample.words)
    ends = np.append(starts, len(grams))
    gram_sets = [grams[a:b] for a, b in zip(ends, ends[1:])]
    # Evidence on a learning text comes from the texts of other folds, as it does for a new text.
    fold = np.arange(len(sample.texts)) % EVIDENCE_FOLDS
    counts = [np.zeros((EVIDENCE_FOLDS, 2, n), np.float32) for n in (WORD_BUCKETS, GRAM_BUCKETS)]
    for text, label, k in zip(sample.texts, sample.labels, fold):
        own = np.unique(text)
        if len(own):
            counts[0][k, label, np.unique(word[own])] += 1
            counts[1][k, label, np.unique(np.concatenate([gram_sets[i] for i in own]))] += 1
    size = np.array([[((sample.labels == y) & (fold == k)).sum() for y in (0, 1)] for k in range(EVIDENCE_FOLDS)])

    def odds_without(k: int | None) -> tuple[np.ndarray, np.ndarray]:
        used = np.arange(EVIDENCE_FOLDS) != k
        n = size[used].sum(0)
        return tuple(evidence(c[used, 1].sum(0), n[1], c[used, 0].sum(0), n[0]) for c in counts)

    net = new_network(*odds_without(None), seed=seed)
    by_fold = [odds_without(k) for k in range(EVIDENCE_FOLDS)]
    first = [(t, a) for t, text in enumerate(sample.texts) for a in windows(len(text))]
    of_text = np.array([t for t, _ in first])
    rows = np.full((len(first), WINDOW), -1, np.int32)
    for row, (t, a) in zip(rows, first):
        part = sample.texts[t][a : a + WINDOW]
        row[: len(part)] = part
    row_fold = fold[of_text]
    rng = np.random.default_rng(seed)
    # The evidence alone tells where to look at first.
    guess = np.zeros(len(rows))
    for k, (of_word, of_gram) in enumerate(by_fold):
        strength = np.append(of_word[word] + np.maximum.reduceat(of_gram[grams], starts), -10.0)
        guess[row_fold == k] = strength[rows[row_fold == k]].max(1)
    toxic, clean = np.flatnonzero(sample.labels == 1), np.flatnonzero(sample.labels == 0)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    by_text = np.split(np.arange(len(first)), np.flatnonzero(np.diff(of_text)) + 1)
    for step in range(1, STEPS + 1):
        if step in (STEPS // 4, STEPS // 2, 3 * STEPS // 4):
            for k in range(EVIDENCE_FOLDS):
                here = Network(*by_fold[k], net.p)
                guess[row_fold == k] = score_rows(here, sample.words, rows[row_fold == k])
        top = np.array([own[np.argmax(guess[own])] for own in by_text])
        third = BATCH // 3
        hard = clean[np.argsort(-guess[top[clean]])[: max(third, len(clean) // 8)]]
        chosen = np.concatenate([top[rng.choice(toxic, third)], top[rng.choice(hard, third)], rng.choice(np.flatnonzero(sample.labels[of_text] == 0), third)])
        k = step % EVIDENCE_FOLDS
        chosen = chosen[row_fold[chosen] == k] if (row_fold[chosen] == k).any() else chosen
        label = sample.labels[of_text[chosen]].astype(np.float32)
        used, at = np.unique(rows[chosen], return_inverse=True)
        at = at.reshape(len(chosen), WINDOW)
        own_words = [sample.words[i] if i >= 0 else "" for i in used]
        x, (w, g, number) = Network(*by_fold[k], net.p).inputs(own_words)
        gates, present = net.gates(x)[at], (rows[chosen] >= 0).astype(np.float32)
        logit, kept = net.forward(gates, present)
        # A toxic text's highest window may be a wrong guess: it counts a little less.
        grad, dgates = net.backward(gates, present, kept, (sigmoid(logit) - label).astype(np.float32) / len(chosen))
        summed = np.zeros((len(used), 2, 3 * HIDDEN), np.float32)
        np.add.at(summed, at.ravel(), dgates.reshape(-1, 2, 3 * HIDDEN))
        dx = np.zeros_like(x)
        for d in (0, 1):
            grad[f"in{d}"], grad[f"bias{d}"] = x.T @ summed[:, d], summed[:, d].sum(0)
            dx += summed[:, d] @ net.p[f"in{d}"].T
        grad["words"], grad["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
        np.add.at(grad["words"], w, dx[:, 3 : 3 + EMBEDDED])
        np.add.at(grad["grams"], g, np.repeat(dx[:, 3 + EMBEDDED :] / number, number[:, 0], axis=0))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k, v in net.p.items():
            m, q = moment[k]
            m += 0.1 * (grad[k] - m)
            q += 0.01 * (grad[k] ** 2 - q)
            own_rate = rate * EMBEDDING_RATE if k in ("words", "grams") else rate
            v -= (own_rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def score_rows(net: Network, words: list[str], rows: np.ndarray) -> np.ndarray:
    """Log odds of windows given as word numbers, -1 where a window has ended."""
    known = [*words, ""]
    table = np.concatenate([net.gates(net.inputs(known[a : a + WORDS_AT_ONCE])[0]) for a in range(0, len(known), WORDS_AT_ONCE)])
    return score_windows(net, table, np.where(rows >= 0, rows, len(words)), rows >= 0)


def score_windows(net: Network, table: np.ndarray, rows: np.ndarray, present: np.ndarray, block: int = 4096) -> np.ndarray:
    """As ``forward``, but keeps only what the score needs; table: gates of each word."""
    p, out = net.p, np.zeros(len(rows), np.float32)
    sides = [np.ascontiguousarray(table[:, d]) for d in (0, 1)]
    loops = [np.ascontiguousarray(p[f"loop{d}"].T) for d in (0, 1)]
    look = np.ascontiguousarray(p["look"].T)
    for a in range(0, len(rows), block):
        own, seen = rows[a : a + block].T, present[a : a + block].T
        whole = seen.all(1)
        n, states = own.shape[1], np.zeros((WINDOW, 2 * HIDDEN, own.shape[1]), np.float32)
        for d in (0, 1):
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                gate = np.ascontiguousarray(sides[d][own[t]].T)
                inner = loops[d] @ h
                both = np.tanh((gate[: 2 * HIDDEN] + inner[: 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                move = both[:HIDDEN]
                if not whole[t]:
                    move = move * seen[t]
                h = h + move * (np.tanh(gate[2 * HIDDEN :] + both[HIDDEN:] * inner[2 * HIDDEN :]) - h)
                states[t, d * HIDDEN : (d + 1) * HIDDEN] = h
        weight = np.stack([p["ask"] @ np.tanh(look @ s + p["look_bias"][:, None]) for s in states])
        weight = np.where(seen, weight, np.float32(-30))
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        values = np.stack([p["out"] @ s for s in states])
        out[a : a + block] = (weight * values).sum(0) + p["out_bias"][0]
    return out


class Scorer:
    """Scores texts; remembers the gates of words met lately."""

    def __init__(self, net: Network):
        self.net, self.known = net, Remembered()

    def gates_of(self, words: list[str]) -> np.ndarray:
        fresh = list(self.known.lacking(set(words)))
        if fresh:
            gates = self.net.gates(self.net.inputs(fresh)[0]).reshape(len(fresh), -1)
            self.known[0].update(zip(fresh, [row.tobytes() for row in gates.astype(np.float32)]))
        raw = b"".join(map(self.known[0].__getitem__, words))
        return np.frombuffer(raw, np.float32).reshape(len(words), 2, 3 * HIDDEN)

    def score(self, texts: pa.Array) -> np.ndarray:
        lists = tokens(texts)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        gates = self.gates_of([*words, ""])
        numbers = np.append(coded.indices.to_numpy().astype(np.int64), np.full(WINDOW, len(words)))
        ends = lists.offsets.to_numpy().astype(np.int64)
        starts = [np.array(windows(n)) for n in np.diff(ends).tolist()]
        of_text = np.repeat(np.arange(len(starts)), list(map(len, starts)))
        at = np.concatenate([ends[k] + s for k, s in enumerate(starts)]) if starts else np.zeros(0, np.int64)
        place = at[:, None] + np.arange(WINDOW)
        present = place < ends[of_text + 1][:, None]
        rows = np.where(present, numbers[np.minimum(place, len(numbers) - 1)], len(words))
        best = np.full(len(starts), -30.0)
        np.maximum.at(best, of_text, score_windows(self.net, gates, rows, present))
        # A text without words comes as one empty word.
        wordless = pc.equal(pc.list_element(lists, 0), "").to_numpy(zero_copy_only=False)
        return np.where(wordless, 0.0, sigmoid(best))


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """About SAMPLE_ROWS rows of each label, by a digest of their ids; never held-out ones."""
    usable = labels.filter(may_learn(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    sizes = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return [], []
    share = id_share(F.col("i"))
    chosen = usable.filter(((F.col("y") == 0) & (share < SAMPLE_ROWS / sizes[0])) | ((F.col("y") == 1) & (share < SAMPLE_ROWS / sizes[1])))
    few = F.broadcast(chosen.distinct())  # about 2 * SAMPLE_ROWS rows, whatever the corpus
    worded = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").rlike(r"[\p{L}\p{N}]"))
    rows = worded.join(few, "i").select(id_share(F.col("i")).alias("s"), drawn(F.col("t"), F.col("i"), PIECES, PIECE).alias("t"), "y").collect()
    rows.sort(key=lambda r: (r["s"], r["t"], r["y"]))
    return [r["t"] for r in rows], [int(r["y"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    texts, values = learning_sample(docs, labels, id_col, text_col, label_col)
    return train_network(sample_of(texts, values)) if len(set(values)) == 2 else None


def score_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            parts = [scorer.score(t) if scorer else np.zeros(len(t)) for t in slices(batch.column(1), 2_000_000)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    net = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score_documents(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
