"""BPE encoding and decoding with a contiguous rank array.

Files of kind "word": text is put in NFC, lower-cased, and split at white
space; the pieces of a word are merged within the word, whose last symbol ends
in ``</w>``. Each merge loop holds the part boundaries of one short word and
the ranks of adjacent parts in two lists: it scans for the smallest rank,
deletes that boundary, and refreshes the ranks on either side.

Since no piece spans white space, texts are taken apart into distinct words and
these into pieces, and each worker remembers the pieces it has met lately, their
forms in Arrow columns. Defined results: a null text is empty; an
empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .words import WHITE_SPACE, WORDS, RememberedRows, slices, split_words

#: Pieces up to this many bytes are merged many at a time, longer ones singly.
SHORT_BYTES = 40
#: Pieces that a task remembers, twice over, and bytes of text that it takes at a time; bounds on
#: memory that change no result.
REMEMBERED, SLICE_BYTES = 100_000, 2_000_000
#: Stands where a row of parts has ended.
NO_PART = (1 << 20) - 1

# Fixed values of this kind of file: the pieces, the end mark.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PIECE = regex.compile(PIECES.replace(r"\s", WHITE_SPACE))
PIECE_OR_LINE = regex.compile(PIECE.pattern + r"|\n")


def normalise(text: str) -> str:
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    # Letter by letter: a capital sigma becomes the same small letter everywhere.
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def pieces_of(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of all words in lists, where the lists begin and end, and the place of each word's list."""
    # No word and no piece holds a line end, so all are worked on at once.
    words = normalise("\n".join(words)).split("\n") if words else []
    whole = np.fromiter(map(str.isalpha, words), bool, len(words))  # letters only: one piece
    found = PIECE_OR_LINE.findall("\n".join([*compress(words, ~whole), ""])) if not whole.all() else []
    line_ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    counts = np.concatenate([np.ones(whole.sum(), np.int64), np.diff(line_ends, prepend=-1) - 1])
    places = np.empty(len(words), np.int64)
    places[np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])] = np.arange(len(words))
    return [*compress(words, whole), *filter("\n".__ne__, found)], np.concatenate([[0], np.cumsum(counts)]), places


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def joined(ends: np.ndarray | pa.Array, values: pa.Array) -> pa.Array:
    """Runs of values with a space between; ``ends`` tells where they begin and end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), " ")


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        numbers = range(max(self.tokens) + 1)
        self.printed_ids = [pa.array(list(map(str, numbers))), pa.array([self.tokens.get(i, "") for i in numbers])]
        self.first_ids = np.array([self.ids[c] for c in self.symbols])
        self.last_ids = np.array([self.ids[c + WORD_END] for c in self.symbols])
        pairs = sorted((self.ids[a] << 20 | self.ids[b], r) for (a, b), r in self.ranks.items())
        self.pair_keys, self.pair_rank = np.array(pairs, np.int64).T.copy()
        self.merged_ids = np.array([self.ids[a + b] for a, b in self.ranks])
        self.known = RememberedRows([pa.string(), pa.string()], REMEMBERED)  # ids in decimal, decoded form

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        symbols = "".join(map(self.symbols.__getitem__, piece.encode("utf-8")))
        n, never = len(symbols), len(self.ranks)
        whole = symbols + WORD_END

        def part(a: int, b: int) -> str:
            return whole[a:] if b == n else symbols[a:b]

        rank = self.ranks.get
        bounds = list(range(n + 1))
        ranks = [rank((part(i, i + 1), part(i + 1, i + 2)), never) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((part(bounds[i], bounds[i + 1]), part(bounds[i + 1], bounds[i + 2])), never)
            if i > 0:
                ranks[i - 1] = rank((part(bounds[i - 1], bounds[i]), part(bounds[i], bounds[i + 1])), never)
        ids = self.ids
        return [ids[part(a, b)] for a, b in zip(bounds, bounds[1:])]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without white space."""
        out: list[int] = []
        for segment in self.specials.split(word) if "<|" in word else (word,):
            if segment in self.special:
                out.append(self.special[segment])
                continue
            for piece in PIECE.findall(normalise(segment)):
                out += self.merge(piece)
        return out

    def split(self, text: str) -> list[str]:
        return WORDS.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self.encode_word(word)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, the form in which a file without a decoder gives them."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The loop of ``merge`` for many short pieces at once, one row each.

        Returns the numbers of the pieces in the order in which they were ready,
        how many ids each has, and the ids.
        """
        n, width = len(pieces), max(map(len, pieces)) + 1
        rows, pos = np.arange(n), np.arange(width)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = np.where(pos < length[:, None], self.first_ids[raw], NO_PART)
        ids[rows, length - 1] = self.last_ids[raw[rows, length - 1]]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        order, counts, flat = [rows[:0]], [rows[:0]], [rows[:0]]
        while len(rows):
            i = ranks.argmin(1)
            at = np.arange(len(rows))
            least = ranks[at, i]
            done = least == len(self.ranks)
            if done.any():
                ready = ids[done]
                order.append(rows[done])
                counts.append((ready != NO_PART).sum(1))
                flat.append(ready[ready != NO_PART])
                rows, ids, ranks, i, least = rows[~done], ids[~done], ranks[~done], i[~done], least[~done]
                at = at[: len(rows)]
            ids[at, i] = self.merged_ids[least]
            # Deleting a boundary moves what stands right of it one place to the left.
            ids = np.take_along_axis(ids, np.minimum(pos + (pos > i[:, None]), width - 1), 1)
            ids[:, -1] = NO_PART
            gaps = pos[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(gaps + (gaps >= i[:, None]), width - 2), 1)
            ranks[at, i] = self.pair_ranks(ids[at, i], ids[at, i + 1])
            left = i > 0
            ranks[at[left], i[left] - 1] = self.pair_ranks(ids[at[left], i[left] - 1], ids[at[left], i[left]])
        return np.concatenate(order), np.concatenate(counts), np.concatenate(flat)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; the number of merges where the pair has none."""
        key = (left.astype(np.int64) << 20) | right
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_rank[k], len(self.ranks))

    def piece_forms(self, pieces: list[str]) -> tuple[list[str], list[pa.Array]]:
        """The pieces in some order, and their ids in decimal and decoded."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        long: list[str] = []
        for piece in pieces:
            raw = piece.encode("utf-8")
            if len(raw) > SHORT_BYTES:
                long.append(piece)
            else:
                by_width.setdefault((len(raw) + 3) // 4, []).append((piece, raw))
        merged = list(map(self.merge, long))
        keys, counts, flat = long, [np.fromiter(map(len, merged), np.int64, len(merged))], [np.fromiter(chain(*merged), np.int64)]
        for group in by_width.values():
            order, n, ids = self.merge_rows([r for _, r in group])
            keys += [group[k][0] for k in order.tolist()]
            counts.append(n)
            flat.append(ids)
        ends, ids = np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(flat)
        return keys, [joined(ends, table.take(pa.array(ids))) for table in self.printed_ids]

    def word_forms(self, words: list[str]) -> list[pa.Array]:
        """The words' ids in decimal, and their decoded forms."""
        marked = np.fromiter(("<|" in w for w in words), bool, len(words))
        pieces, ends, places = pieces_of(["" if m else w for w, m in zip(words, marked)] if marked.any() else words)
        rows = pa.array(self.known.rows(pieces, self.piece_forms))
        out = [joined(ends, column.take(rows)).take(pa.array(places)) for column in self.known.columns]
        if marked.any():
            ids = [self.encode_word(w) for w in compress(words, marked)]
            shown = [" ".join(map(str, x)) for x in ids], [self.decode(x) for x in ids]
            out = [pc.replace_with_mask(forms, pa.array(marked), pa.array(x, pa.string())) for forms, x in zip(out, shown)]
        return out

    def forget(self) -> None:
        """Release what one task remembered."""
        self.known.forget()
        pa.default_memory_pool().release_unused()

    def printed(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids of each text in decimal, and its decoded form, both joined by one space."""
        split = split_words(texts)
        coded = split.values.dictionary_encode()
        ids, back = (joined(split.offsets, forms.take(coded.indices)) for forms in self.word_forms(coded.dictionary.to_pylist()))
        return ids, back


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker and file, kept between tasks."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    ``vocabulary`` is a path that every executor can open; by default the file
    that is installed with Python there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary or default_vocabulary())
        for batch in batches:
            counts, digests, decoded = [], [], []
            for texts in slices(batch.column(1), SLICE_BYTES):
                ids, back = bpe.printed(texts)
                counts += pc.add(pc.count_substring(ids, " "), pc.not_equal(ids, "").cast(pa.int32())).to_pylist()
                digests += [hashlib.sha256(x.as_buffer()).hexdigest() for x in ids]
                decoded += [hashlib.sha256(x.as_buffer()).hexdigest() for x in back]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text, as array<int>, in ``out_col``."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != out_col]
    kept = docs.select(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary or default_vocabulary())
        for batch in batches:
            ids = [np.array(bpe.encode(t.as_py() or ""), np.int32) for t in batch.column(at)]
            column = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(documents(spark, folder))
