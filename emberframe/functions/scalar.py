"""Column expressions for transforms, model terms and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_log(c: str | Column) -> Column:
    """Natural log that fails on zero or below instead of returning null."""
    c = _col(c)
    return F.when(c.isNull() | (c > 0), F.log(c)).otherwise(
        F.raise_error(F.lit("log of a value that is not positive")).cast("double")
    )


def log_plus_one(c: str | Column) -> Column:
    return F.log1p(_col(c))


def log10(c: str | Column) -> Column:
    return F.log10(_col(c))


def log10_plus_one(c: str | Column) -> Column:
    return F.log10(_col(c) + 1)


def square_root(c: str | Column) -> Column:
    return F.sqrt(_col(c))


def cube_root(c: str | Column) -> Column:
    """Signed cube root."""
    return F.cbrt(_col(c))


def square(c: str | Column) -> Column:
    c = _col(c)
    return c * c


def product(a: str | Column, b: str | Column) -> Column:
    return _col(a) * _col(b)


def fixed_width(c: str | Column, digits: int) -> Column:
    """Round and print with exactly ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", F.round(_col(c).cast("double"), digits))


def is_missing(c: str | Column) -> Column:
    """Null or NaN, which are one and the same 'missing' here."""
    c = _col(c)
    return c.isNull() | F.isnan(c.cast("double"))


def zero_if_missing(c: str | Column) -> Column:
    c = _col(c)
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def joined_text(*parts: str | Column) -> Column:
    return F.concat(*[_col(p).cast("string") for p in parts])


TRANSFORMS = {
    "identity": _col,
    "log": strict_log,
    "log1p": log_plus_one,
    "log10": log10,
    "sqrt": square_root,
    "cube_root": cube_root,
}
