"""Distributed sums of small vectors computed by NumPy over blocks of rows.

The one primitive under every fit: executors reduce their rows to a few
hundred numbers per key, Spark adds those up, and only the totals reach the
driver. Their count depends on the model, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
BLOCK_ROWS = 65_536
HELD_NUMBERS = 16_000_000  # 128 MB of running totals per task
MISSING = "\x1e<missing>"  # begins with a separator, which sets it apart from a group of that name

Key = tuple[str, ...]
Block = Callable[[Key, np.ndarray], Iterable[tuple[str, np.ndarray]]]


def key_text(name: str) -> Column:
    """The one text by which all model families name a stratum or group; a missing key has its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def strata_of(df: DataFrame, stratum: str | None) -> list[str]:
    """Names of the strata; one empty name without a stratum column."""
    return sorted(r[0] for r in df.select(key_text(stratum)).distinct().collect()) if stratum else [""]


def sum_blocks(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], block: Block
) -> dict[tuple[Key, str], np.ndarray]:
    """Add up the labelled vectors that ``block`` gives for the rows of each key.

    ``block(key, columns)`` sees the values as a (values, rows) matrix, missing
    ones as NaN, and may be called several times per key; its vectors must be
    sums over rows.
    """
    key = F.concat_ws(SEPARATOR, *[key_text(k) for k in keys])
    data = df.select(key.alias("key"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    width = len(values)

    def partial_sums(batches):
        import pyarrow as pa

        totals: dict[tuple[str, str], np.ndarray] = {}
        held, rows, numbers = [], 0, 0

        def reduce_held():
            nonlocal numbers
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table.column(0).combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            names = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            matrix = np.empty((width, table.num_rows))
            for i in range(width):
                matrix[i] = table.column(i + 1).to_numpy()
            if len(names) == 1:
                parts = [(0, matrix)]
            else:
                codes = codes.astype(np.uint16) if len(names) < 65_536 else codes
                order = np.argsort(codes, kind="stable")
                matrix = matrix[:, order]
                ends = np.flatnonzero(np.diff(codes[order])) + 1
                starts = np.concatenate([[0], ends])
                parts = [(codes[order[at]], matrix[:, at:end]) for at, end in zip(starts, [*ends, len(order)])]
            for code, columns in parts:
                name = names[code]
                for label, vector in block(tuple(name.split(SEPARATOR)), columns):
                    if (name, label) in totals:
                        totals[name, label] += vector
                    else:
                        totals[name, label] = np.array(vector, dtype=float)
                        numbers += len(vector)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                reduce_held()
                held, rows = [], 0
                if numbers > HELD_NUMBERS:
                    yield from _batches(totals)
                    totals.clear()
                    numbers = 0
        if held:
            reduce_held()
        yield from _batches(totals)

    # one short row per task, key and label; its numbers are added up place by place,
    # so that a single key, as of an unstratified model, is dealt to many tasks too
    partial = data.mapInArrow(partial_sums, "key string, label string, sums array<double>")
    each = partial.select("key", "label", F.posexplode("sums").alias("place", "number"))
    total = each.groupBy("key", "label", "place").agg(F.sum("number").alias("number"))
    return _gathered(total.toArrow())


def _gathered(total) -> dict[tuple[Key, str], np.ndarray]:
    """Vectors by key and label from rows (key, label, place, number), as many as a model's sums have."""
    if not total.num_rows:
        return {}
    columns = total.combine_chunks()
    key, label = (columns.column(i).combine_chunks().dictionary_encode() for i in range(2))
    place, number = (columns.column(i).to_numpy() for i in (2, 3))
    codes = key.indices.to_numpy().astype(np.int64) * len(label.dictionary) + label.indices.to_numpy()
    order = np.lexsort((place, codes))
    codes, number = codes[order], number[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    out = {}
    for at, vector in zip(starts, np.split(number, starts[1:])):
        k, name = divmod(int(codes[at]), len(label.dictionary))
        if np.isnan(vector).any():
            raise ValueError("missing values among the model columns; drop incomplete rows first")
        out[tuple(key.dictionary[k].as_py().split(SEPARATOR)), label.dictionary[name].as_py()] = vector
    return out


def _batches(totals: dict[tuple[str, str], np.ndarray]):
    import pyarrow as pa

    items = list(totals.items())
    for at in range(0, len(items), 1000):
        some = items[at : at + 1000]
        ends = np.cumsum([0] + [len(v) for _, v in some]).astype("int32")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for (k, _), _ in some], pa.string()),
                pa.array([label for (_, label), _ in some], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v for _, v in some]))),
            ],
            names=["key", "label", "sums"],
        )


def packed(matrix: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix as a vector."""
    return matrix[np.triu_indices(len(matrix))]


def unpacked(vector: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    upper = np.triu_indices(size)
    out[upper] = vector[: len(upper[0])]
    out.T[upper] = out[upper]
    return out
