"""Missing-value algebra on Columns.

A missing number is NULL and is larger than every number: ``gt(x, 5)`` holds for it,
``lt(x, 5)`` does not. The forms compile to plain comparisons and null tests, so Parquet
filters are still pushed down. NaN is turned into NULL by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column by name, a Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float and double column."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in kinds.items() if t in ("double", "float")}) if any(t in ("double", "float") for t in kinds.values()) else df


def gt(x, y) -> Column:
    """x > y, a missing x being above every number."""
    if not isinstance(y, (Column, str)):
        return (col(x) > y) | col(x).isNull()
    return F.coalesce(col(x) > col(y), F.lit(False)) | (col(x).isNull() & col(y).isNotNull())


def ge(x, y) -> Column:
    if not isinstance(y, (Column, str)):
        return (col(x) >= y) | col(x).isNull()
    return F.coalesce(col(x) >= col(y), F.lit(False)) | col(x).isNull()


def lt(x, y) -> Column:
    """x < y; a missing x is below nothing, every number is below a missing y."""
    if not isinstance(y, (Column, str)):
        return F.coalesce(col(x) < y, F.lit(False))
    return gt(y, x)


def le(x, y) -> Column:
    if not isinstance(y, (Column, str)):
        return F.coalesce(col(x) <= y, F.lit(False))
    return ge(y, x)


def eq(x, y) -> Column:
    """Equal, missings being equal to each other."""
    return col(x).eqNullSafe(y if not isinstance(y, (Column, str)) else col(y))


def ne(x, y) -> Column:
    return ~eq(x, y)


def missing(*xs) -> Column:
    """Any of the arguments is missing: NULL, NaN is not expected after ``clean``; for strings also empty."""
    out = F.lit(False)
    for x in xs:
        out = out | col(x).isNull() | (col(x).cast("string") == "")
    return out


def truth(p: Column) -> Column:
    """A condition as used in and/or: missing counts as false."""
    return F.coalesce(p, F.lit(False))


def and_(a: Column, b: Column) -> Column:
    return truth(a) & truth(b)


def or_(a: Column, b: Column) -> Column:
    return truth(a) | truth(b)


def not_(a: Column) -> Column:
    """not missing stays missing."""
    return ~a


def num(p: Column) -> Column:
    """A condition as the number 1 or 0."""
    return p.cast("double")


def cond(p: Column, a, b) -> Column:
    return F.when(truth(p), col(a)).otherwise(col(b))


def inrange(x, low, high) -> Column:
    return F.coalesce(col(x).between(low, high), F.lit(False))


def inlist(x, *values) -> Column:
    return F.coalesce(col(x).isin(*values), F.lit(False))


def max_of(*xs) -> Column:
    return F.greatest(*map(col, xs)) if len(xs) > 1 else col(xs[0])


def min_of(*xs) -> Column:
    return F.least(*map(col, xs)) if len(xs) > 1 else col(xs[0])
