"""Model terms: intercept, a two-level factor, drivers, squares, interactions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Base:
    """A driver to some power; power 0 is the constant."""

    driver: str
    power: int

    @property
    def name(self) -> str:
        return {0: INTERCEPT, 1: self.driver}.get(self.power, f"I({self.driver}^{self.power})")

    def column(self) -> Column:
        if self.power == 0:
            return F.lit(1.0)
        c = F.col(self.driver).cast("double")
        return c if self.power == 1 else F.pow(c, F.lit(float(self.power)))


@dataclass(frozen=True)
class Term:
    """A base, or its product with the factor dummy."""

    base: Base
    by_factor: bool
    factor: str | None

    @property
    def name(self) -> str:
        if not self.by_factor:
            return self.base.name
        return self.factor if self.base.power == 0 else f"{self.factor}:{self.base.name}"

    def column(self) -> Column:
        return self.base.column() * F.col(self.factor) if self.by_factor else self.base.column()


CONSTANT = Base("", 0)


def model_terms(
    drivers: Sequence[str], squares: Sequence[str] = (), factor: str | None = "No_IDL", without: Iterable[str] = ()
) -> tuple[Term, ...]:
    """Constant, factor, drivers, squares, then all of them by the factor.

    ``without`` names terms to leave out, as printed in coefficient tables.
    """
    bases = [Base(d, 1) for d in drivers] + [Base(d, 2) for d in squares]
    terms = [Term(CONSTANT, False, factor)]
    if factor:
        terms.append(Term(CONSTANT, True, factor))
    terms += [Term(b, False, factor) for b in bases]
    if factor:
        terms += [Term(b, True, factor) for b in bases]
    left_out = set(without)
    unknown = left_out - {t.name for t in terms}
    if unknown:
        raise ValueError(f"no such terms: {sorted(unknown)}")
    return tuple(t for t in terms if t.name not in left_out)


def model_matrix(df: DataFrame, terms: Sequence[Term], keep: Sequence[str] = ()) -> DataFrame:
    """The model matrix as columns named after the terms."""
    return df.select(*keep, *[t.column().alias(t.name) for t in terms])


def factor_dummy(df: DataFrame, column: str, second_level: str, name: str) -> DataFrame:
    """0/1 dummy of the second sorted level; the first is the baseline."""
    return df.withColumn(name, (F.col(column) == second_level).cast("double"))


class Expansion:
    """Turns driver columns into the base columns shared by several formulas.

    Interactions need no columns of their own: sums are kept per factor level,
    and an interaction's products are those of the second level alone.
    """

    def __init__(self, formulas: Iterable[Sequence[Term]]):
        seen: dict[Base, int] = {CONSTANT: 0}
        for terms in formulas:
            for t in terms:
                seen.setdefault(t.base, len(seen))
        self.bases = list(seen)
        self.place = seen
        self.drivers = sorted({b.driver for b in self.bases if b.power})

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        """(bases, rows) from a matrix whose first rows are the drivers."""
        at = {d: i for i, d in enumerate(self.drivers)}
        out = np.ones((len(self.bases), columns.shape[1]))
        for i, b in enumerate(self.bases):
            if b.power:
                out[i] = columns[at[b.driver]] ** b.power
        return out

    def assemble(self, low: np.ndarray, high: np.ndarray, terms: Sequence[Term]) -> np.ndarray:
        """Cross products of the terms (and the response, last) from those per factor level."""
        size = len(self.bases)
        index = [self.place[t.base] for t in terms]
        by = [t.by_factor for t in terms]
        if low.shape[-1] > size:
            index, by = index + [size], by + [False]
        pick = np.ix_(index, index)
        only_high = np.logical_or.outer(by, by)
        h = high[(..., *pick)]
        return np.where(only_high, h, h + low[(..., *pick)])

    def assemble_vector(self, low: np.ndarray, high: np.ndarray, terms: Sequence[Term]) -> np.ndarray:
        index = [self.place[t.base] for t in terms]
        by = np.array([t.by_factor for t in terms])
        return np.where(by, high[index], high[index] + low[index])

    def level_coefficients(self, terms: Sequence[Term], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the bases at each factor level."""
        low, high = np.zeros(len(self.bases)), np.zeros(len(self.bases))
        for t, b in zip(terms, beta):
            high[self.place[t.base]] += b
            if not t.by_factor:
                low[self.place[t.base]] += b
        return low, high
