"""reshape long and wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.prep import DataError

#: Levels become columns, so a table takes only so many.
MAX_LEVELS = 5_000


def level_text(v) -> str:
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def long(df: DataFrame, stubs: list[str], i: list[str], j: str, string: bool = False, verify: bool = True) -> DataFrame:
    """Wide to long: the levels of j come from the names; a missing (stub, level) gives a missing value; other columns are carried."""
    if j in df.columns:
        raise DataError(110, f"{j} already defined")
    levels = set()
    for stub in stubs:
        for c in df.columns:
            tail = c[len(stub) :]
            if c.startswith(stub) and tail and c not in i and (string or tail.isdigit()):
                levels.add(tail)
    if not levels:
        raise DataError(111, "no columns to reshape")
    if verify and not df.groupBy(*i).count().filter("count > 1").isEmpty():
        raise DataError(9, f"{' '.join(i)} do not uniquely identify the rows")
    levels = sorted(levels, key=(lambda x: x) if string else int)
    kinds = dict(df.dtypes)
    used = {s + lv for s in stubs for lv in levels}
    carried = [c for c in df.columns if c not in used and c not in i]
    kind = {s: next(kinds[s + lv] for lv in levels if s + lv in kinds) for s in stubs}
    row = lambda lv: F.struct(F.lit(lv if string else int(lv)).alias(j), *[(F.col(s + lv) if s + lv in kinds else F.lit(None)).cast(kind[s]).alias(s) for s in stubs])
    return df.select(*i, F.explode(F.array(*map(row, levels))).alias("__r"), *carried).select(*i, "__r.*", *carried)


def wide(df: DataFrame, stubs: list[str], i: list[str], j: str, levels: list | None = None, verify: bool = True) -> DataFrame:
    """Long to wide, columns stub + level. Errors: 498 missing j, 9 repeated j or a carried column that varies within i."""
    carried = [c for c in df.columns if c not in {*stubs, *i, j}]
    if verify:
        checks = [F.count_if(F.col(j).isNull()).alias("gone")]
        if df.agg(*checks).first()["gone"]:
            raise DataError(498, f"{j} has missing values")
        if not df.groupBy(*i, j).count().filter("count > 1").isEmpty():
            raise DataError(9, f"{j} repeats within {' '.join(i)}")
        if carried:
            varies = df.groupBy(*i).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in carried])
            if not varies.filter(" or ".join(f"`{c}` > 1" for c in carried)).isEmpty():
                raise DataError(9, "a carried variable is not constant")
    if levels is None:
        found = df.select(j).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise DataError(198, f"more than {MAX_LEVELS} levels of {j}")
        levels = sorted(r[0] for r in found if r[0] is not None)
    cells = [F.max(F.when(F.col(j) == F.lit(v), F.col(s))).alias(s + level_text(v)) for v in levels for s in stubs]
    return df.groupBy(*i).agg(*cells, *[F.first(c, ignorenulls=False).alias(c) for c in carried])
