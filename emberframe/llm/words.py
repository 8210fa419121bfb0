"""Texts as words inside a task, many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How many words a worker remembers, twice over; a bound on memory that changes no result.
REMEMBERED_WORDS = 220_000

# Unicode's white space, and what Arrow also takes for it.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = b"\x1c\x1d\x1e\x1f"
WORDS = re.compile(f"[^{WHITE_SPACE}]+")


class Remembered(list):
    """``n`` dicts with the same words as keys: the last ``words`` met, and as many before them."""

    def __init__(self, n: int = 1, words: int = REMEMBERED_WORDS):
        super().__init__({} for _ in range(n))
        self.older: list[dict] = [{} for _ in range(n)]
        self.words = words

    def forget(self) -> None:
        """Start anew, so that a worker that waits for its next task holds no words."""
        self[:] = [{} for _ in self]
        self.older = [{} for _ in self]

    def lacking(self, words: set[str]) -> set[str]:
        """Those of ``words`` that have to be worked out; all others can be looked up afterwards."""
        fresh = words.difference(self[0])
        if len(self[0]) + len(fresh) > self.words:
            self.older = list(self)
            self[:] = [{} for _ in self]
            fresh = set(words)
        again = fresh.intersection(self.older[0])
        for now, before in zip(self, self.older):
            now.update(zip(again, map(before.__getitem__, again)))
        return fresh.difference(again)


class RememberedRows:
    """Rows of Arrow columns by key: those of the last ``size`` keys met, and of as many before them."""

    def __init__(self, types: list[pa.DataType], size: int = REMEMBERED_WORDS):
        self.types, self.size = types, size
        self.forget()

    def forget(self) -> None:
        """Start anew, so that a worker that waits for its next task holds no rows."""
        self.numbers: dict[str, int] = {}
        self.columns = [pa.array([], t) for t in self.types]
        self.older = self.numbers, self.columns

    def rows(self, keys: list[str], work_out: Callable[[list[str]], tuple[list[str], list[pa.Array]]]) -> np.ndarray:
        """The numbers of the keys' rows in ``columns``; ``work_out`` gives rows for new keys, in an order of its own."""
        distinct = set(keys)
        fresh = distinct.difference(self.numbers)
        if len(self.numbers) + len(fresh) > self.size:
            self.older = self.numbers, self.columns
            self.numbers, self.columns = {}, [pa.array([], t) for t in self.types]
            fresh = distinct
        numbers, columns = self.older
        again = list(fresh.intersection(numbers))
        kept = pa.array(list(map(numbers.__getitem__, again)), pa.int32())
        new, added = work_out(list(fresh.difference(again)))
        self.numbers.update(zip([*again, *new], count(len(self.numbers))))
        self.columns = [pa.concat_arrays([c, old.take(kept), more]) for c, old, more in zip(self.columns, columns, added)]
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int32, len(keys))


def raw_bytes(texts: pa.Array) -> bytes:
    """The UTF-8 bytes of all texts, one after another."""
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return b""
    first, last = texts.offset, texts.offset + len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)
    return data.slice(int(ends[first]), int(ends[last] - ends[first])).to_pybytes()


def slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Runs of successive texts of about ``size`` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, that is what stands between Unicode's white space."""
    raw = raw_bytes(texts)
    if any(c in raw for c in SEPARATORS):
        return pa.array([WORDS.findall(t.as_py()) for t in texts], pa.list_(pa.string()))
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    filled = pc.not_equal(words.values, "")
    if pc.all(filled).as_py() is not False:
        return pa.ListArray.from_arrays(words.offsets, words.values)
    # A text without words comes as one empty word.
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[words.offsets.to_numpy()], pa.int32()), words.values.filter(filled))
