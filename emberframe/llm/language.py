"""Language of a text by a string kernel.

The blended-spectrum presence kernel of two texts counts the letter n-grams,
n = 1 to 3, that both hold, divided by the geometric mean of their numbers.
Landmark texts span the feature space (Nystroem), and kernel ridge regression,
one language against the rest, is solved on a bounded sample of learning rows.
A task scores many texts at once: one presence matrix over the landmarks'
n-grams, times the landmarks, times the weights.

The whole text counts: letters of either case are equal, and everything between
letters is one gap. Letters that no common language of the sample uses share
one class. Defined results: a text that is null, empty or without letters gets
``und`` and 0; extra columns play no part and are kept, whatever their names (see
``predict``); repeated rows get equal rows; with
no learning rows at all every text is ``und``. Ties go to the language that
sorts first.

A score only compares the learned languages: K raw scores add up to 2 - K, so the
best of few is never low. Whether a text is in its language at all is told by the
share of its n-grams that the language's landmarks hold, see ``Model.claims``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, drawn, held_out, id_share, may_learn
from .words import slices

UNDETERMINED = "und"
#: Learning rows for each language, at most.
SAMPLE_ROWS = 300
#: A learning text of up to 32 * 500 characters is learned whole, of a longer one so many pieces from all over it.
PIECES, PIECE = 32, 500
#: Texts that are scored by one product, whatever their length; a bound on memory that changes no result.
TEXTS_AT_ONCE = 256
#: Landmarks for each language.
LANDMARKS = 40
RIDGE = 1e-2
#: Of the shares of known n-grams of learning rows with LONG n-grams or more, so low a quantile
#: is taken for clean; a text may fall short of 1 by SLACK times as much.
LONG, CLEAN, SLACK = 300, 0.005, 2.0
#: What chance may take from a short text: standard deviations of its known n-grams, and the n-grams of one unknown letter.
DEVIATIONS, ONE_LETTER = 2.0, 6
ALPHABET = 128  # class 0 is the gap, class 1 any other letter


@lru_cache(maxsize=1)
def small_letters() -> np.ndarray:
    """For each code point: that of its small letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0])
    return table


@lru_cache(maxsize=4)
def letter_classes(letters: str) -> np.ndarray:
    """For each code point: its class among ``letters``."""
    small = small_letters()
    table = (small > 0).astype(np.uint8)
    for k, c in enumerate(letters, 2):
        table[small == ord(c)] = k
    return table


def gram_codes(text: str, classes: np.ndarray, piece: int = 1_000_000) -> Iterator[np.ndarray]:
    """Codes of all 1-, 2- and 3-grams, gaps included, piece by piece of a long text."""
    tail = np.zeros(1, np.uint8)  # a gap stands before the text, and one after it
    for start in range(0, len(text) + 1, piece):
        part = text[start : start + piece]
        last = start + piece > len(text)
        own = classes[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        run = np.concatenate([tail, own, np.zeros(int(last), np.uint8)])
        run = run[np.concatenate([[True], (run[1:] > 0) | (run[:-1] > 0)])].astype(np.int32)
        yield run[1:]
        yield (run[:-1] * ALPHABET + run[1:])[-len(run) + 1 :] + ALPHABET
        if len(run) > 2:
            yield (run[:-2] * ALPHABET + run[1:-1]) * ALPHABET + run[2:] + ALPHABET * (ALPHABET + 1)
        tail = run[-2:].astype(np.uint8)


CODES = ALPHABET * (1 + ALPHABET + ALPHABET * ALPHABET)


@dataclass
class Model:
    letters: str
    grams: np.ndarray  # codes of the landmarks' n-grams
    landmarks: np.ndarray  # presence of each gram in each landmark, divided by its norm
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    languages: list[str]
    held: np.ndarray  # languages x (grams + 1): whether a landmark of the language holds the gram
    least: float  # share of known n-grams below which a long text is in none of the languages

    def columns(self) -> np.ndarray:
        """For each code its column, the last one (which is dropped) for codes of no landmark."""
        table = np.full(CODES, len(self.grams), np.int32)
        table[self.grams] = np.arange(len(self.grams))
        return table

    def presence(self, texts: list[str], columns: np.ndarray) -> np.ndarray:
        classes = letter_classes(self.letters)
        out = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for row, text in zip(out, texts):
            for codes in gram_codes(text, classes):
                row[columns[codes]] = 1
        return out[:, :-1]

    def kernel(self, texts: list[str], columns: np.ndarray) -> np.ndarray:
        """Kernel of each text with each landmark."""
        present = self.presence(texts, columns)
        norms = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present / norms) @ self.landmarks.T

    def score(self, texts: list[str], columns: np.ndarray) -> np.ndarray:
        return self.kernel(texts, columns) @ self.weights + self.bias

    def claims(self, text: str, language: int, columns: np.ndarray) -> bool:
        """Whether the language's landmarks hold enough of a text's n-grams.

        ``least`` comes from the learning rows, not from the number of languages.
        A text of few letters may fall below it by chance, and one of a single word mostly stays.
        """
        known, grams = known_grams(text, letter_classes(self.letters), columns, self.held[language])
        variance = 3 * grams * max(0.0, self.least * (1 - self.least))  # three n-grams a letter come and go together
        return known >= self.least * grams - DEVIATIONS * variance**0.5 - ONE_LETTER


def known_grams(text: str, classes: np.ndarray, columns: np.ndarray, held: np.ndarray) -> tuple[int, int]:
    """How many n-grams of a text are ``held``, and how many it has; repeated ones count."""
    known = grams = 0
    for codes in gram_codes(text, classes):
        known += int(np.count_nonzero(held[columns[codes]]))
        grams += len(codes)
    return known, grams


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """Ridge regression on Nystroem features; the first texts of each language are its landmarks."""
    names = sorted(set(languages))
    small = small_letters()
    counts: dict[str, int] = {}
    for text in texts:
        for c in set(text):
            if s := int(small[ord(c)]):
                counts[chr(s)] = counts.get(chr(s), 0) + 1
    letters = "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[: ALPHABET - 2]))
    classes = letter_classes(letters)
    own = [i for n in names for i in [k for k, x in enumerate(languages) if x == n][:landmarks]]
    sets = [np.unique(np.concatenate(list(gram_codes(texts[i], classes)))) for i in own]
    model = Model(letters, np.unique(np.concatenate(sets)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), names, np.zeros((0, 0)), 0.0)
    columns = model.columns()
    present = model.presence([texts[i] for i in own], columns)
    model.landmarks = present / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
    among = (model.landmarks @ model.landmarks.T).astype(float)
    values, vectors = np.linalg.eigh(among)
    used = values > 1e-6 * values.max()
    to_features = vectors[:, used] / np.sqrt(values[used])
    features = model.kernel(texts, columns) @ to_features
    middle = features.mean(0)
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    level = target.mean(0)
    centred = features - middle
    solved = np.linalg.solve(centred.T @ centred + RIDGE * len(texts) * np.eye(len(middle)), centred.T @ (target - level))
    model.weights = (to_features @ solved).astype(np.float32)
    model.bias = (level - middle @ solved).astype(np.float32)
    number = np.zeros((len(names), len(model.grams) + 1), np.int32)
    for i, row in zip(own, present):
        number[names.index(languages[i]), :-1] += row > 0
    model.held = number > 0
    shares = []
    landmark = set(own)
    for i, (text, name) in enumerate(zip(texts, languages)):
        # A landmark's own n-grams must be held by another one as well.
        known, grams = known_grams(text, classes, columns, number[names.index(name)] > (i in landmark))
        if any(small[ord(c)] for c in set(text)):
            shares.append((grams >= LONG, known / grams))
    # Without long rows the short ones must do.
    usable = [x for long, x in shares if long] or [x for _, x in shares]
    model.least = 1 - SLACK * (1 - float(np.quantile(usable, CLEAN))) if usable else 0.0
    return model


def learning_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """About SAMPLE_ROWS rows of each language, by a digest of their ids; never held-out ones."""
    usable = docs.filter(may_learn(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    share = id_share(F.col(id_col))
    wanted = [(F.col(lang_col) == lang) & (share < SAMPLE_ROWS / n) for lang, n in sorted(sizes.items())]
    if not wanted:
        return [], []
    chosen: Column = wanted[0]
    for w in wanted[1:]:
        chosen = chosen | w
    rows = usable.filter(chosen).select(share.alias("s"), drawn(F.col(text_col), F.col(id_col), PIECES, PIECE).alias("t"), F.col(lang_col).alias("l")).collect()
    rows.sort(key=lambda r: (r["s"], r["t"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    texts, languages = learning_sample(docs, id_col, text_col, lang_col)
    return fit(texts, languages) if texts else None


def judged(texts: pa.Array, model: Model | None, columns: np.ndarray | None, with_claims: bool) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and, if asked for, whether the language claims it, of each text."""
    languages: list[str] = []
    scores: list[float] = []
    claimed: list[bool] = []
    small = small_letters()
    for run_of in slices(texts.cast(pa.string()).fill_null(""), 1_000_000):
        run = run_of.to_pylist()
        known = [any(small[ord(c)] for c in set(t)) for t in run]
        starts = range(0, len(run), TEXTS_AT_ONCE)
        parts = [model.score(run[i : i + TEXTS_AT_ONCE], columns) for i in starts] if model else []
        values = np.concatenate(parts) if parts else np.zeros((len(run), 1))
        for text, ok, k, v in zip(run, known, values.argmax(1).tolist(), values.max(1).tolist()):
            good = ok and model is not None
            languages.append(model.languages[k] if good else UNDETERMINED)
            scores.append(min(1.0, max(0.0, (v + 1) / 2)) if good else 0.0)
            if with_claims:
                claimed.append(good and model.claims(text, k, columns))
    return languages, scores, claimed


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from those taken, in either case."""
    while name.lower() in [t.lower() for t in taken]:
        name += "_"
    return name


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1 (0.5: neither for nor against).

    All columns of ``docs`` stay as they are. An added one whose name is taken gets underscores behind it.
    """
    from pyspark.sql import types as T

    lang_out = free_name(lang_out, docs.columns)
    names = [lang_out, free_name(score_out, [*docs.columns, lang_out])]
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = model.columns() if model else None
        for batch in batches:
            languages, scores, _ = judged(batch.column(at), model, columns, False)
            added = [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def claimed_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is in its predicted language at all."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = model.columns() if model else None
        for batch in batches:
            yield batch.filter(pa.array(judged(batch.column(at), model, columns, True)[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = train(docs)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
