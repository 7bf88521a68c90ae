"""Columns and rows: generate, replace, recode, encode, destring and their kin.

Every function takes a DataFrame and returns one; nothing is computed before an action,
except where a documented error check needs one aggregate.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.missing import col, truth


class DataError(ValueError):
    """An error with the code the statistics language knows it by."""

    def __init__(self, rc: int, text: str):
        super().__init__(text)
        self.rc = rc


def varlist(df: DataFrame, spec: str) -> list[str]:
    """Names of a list: ``_all``, ranges ``a-b``, patterns with * and ?, unique prefixes."""
    out: list[str] = []
    for item in spec.split():
        if item == "_all":
            out += df.columns
        elif item in df.columns:
            out.append(item)
        elif "-" in item and all(p in df.columns for p in item.split("-", 1)):
            a, b = (df.columns.index(p) for p in item.split("-", 1))
            out += df.columns[a : b + 1]
        elif any(c in item for c in "*?"):
            hit = [c for c in df.columns if fnmatch.fnmatchcase(c, item)]
            if not hit:
                raise DataError(111, f"no variable matches {item}")
            out += hit
        else:
            hit = [c for c in df.columns if c.startswith(item)]
            if len(hit) != 1:
                raise DataError(111, f"{'ambiguous abbreviation' if hit else 'not found'}: {item}")
            out += hit
    return list(dict.fromkeys(out))


def generate(df: DataFrame, name: str, value, where: Column | None = None) -> DataFrame:
    """A new column, missing where the condition does not hold."""
    if name in df.columns:
        raise DataError(110, f"{name} already defined")
    v = col(value) if not isinstance(value, str) else F.col(value)
    return df.withColumn(name, v if where is None else F.when(truth(where), v))


def replace(df: DataFrame, name: str, value, where: Column | None = None) -> DataFrame:
    if name not in df.columns:
        raise DataError(111, f"{name} not found")
    v = col(value) if not isinstance(value, str) else F.col(value)
    return df.withColumn(name, v if where is None else F.when(truth(where), v).otherwise(F.col(name)))


def keep_if(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(where)


def drop_if(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~truth(where))


def keep(df: DataFrame, spec: str) -> DataFrame:
    names = set(varlist(df, spec))
    return df.select(*[c for c in df.columns if c in names])


def drop(df: DataFrame, spec: str) -> DataFrame:
    return df.drop(*varlist(df, spec))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """``a`` to ``b``, ``x*`` to ``y*``, or lists of both in pairs; swaps are safe."""
    pairs = {}
    olds, news = old.split(), new.split()
    if len(olds) != len(news):
        raise DataError(198, "lists of different length")
    for o, n in zip(olds, news, strict=True):
        if "*" not in o:
            pairs[varlist(df, o)[0]] = n
            continue
        pattern = re.compile("^" + "(.*)".join(map(re.escape, o.split("*"))) + "$")
        for c in df.columns:
            if m := pattern.match(c):
                parts = n.split("*")
                pairs[c] = parts[0] + "".join(g + p for g, p in zip(m.groups(), parts[1:], strict=False))
    out = [pairs.get(c, c) for c in df.columns]
    if len(set(out)) != len(out):
        raise DataError(110, "names would clash")
    return df.toDF(*out)


def order(df: DataFrame, spec: str) -> DataFrame:
    first = varlist(df, spec)
    return df.select(*first, *[c for c in df.columns if c not in first])


def aorder(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns, key=lambda c: (c.lower(), c)))


def label(df: DataFrame, name: str, text: str | None = None, fmt: str | None = None, values: dict | None = None) -> DataFrame:
    """Label, display format and value labels of a column, kept in its metadata."""
    meta = dict(df.schema[name].metadata or {})
    if text is not None:
        meta["label"] = text[:80]
    if fmt is not None:
        meta["format"] = fmt
    if values is not None:
        meta["values"] = {str(k): v for k, v in values.items()}
    return df.withMetadata(name, meta)


def labels(df: DataFrame) -> dict[str, dict]:
    return {f.name: dict(f.metadata) for f in df.schema if f.metadata}


def recode(df: DataFrame, names: list[str], rules: list[tuple], gen: list[str] | None = None) -> DataFrame:
    """First matching rule wins; what matches none passes through.

    A rule is (source, target): source a number, a (low, high) pair with None for an open
    end, a list of these, or one of ``missing``, ``nonmissing``, ``else``.
    """

    def hit(x: Column, source) -> Column:
        if isinstance(source, list):
            out = F.lit(False)
            for one in source:
                out = out | hit(x, one)
            return out
        if isinstance(source, tuple):
            low, high = source
            out = x.isNotNull()
            out = out & (x >= low) if low is not None else out
            return out & (x <= high) if high is not None else out
        named = {"missing": x.isNull(), "nonmissing": x.isNotNull(), "else": F.lit(True)}
        return named[source] if isinstance(source, str) else truth(x == source)

    new = {}
    for name, to in zip(names, gen or names, strict=True):
        x, out = F.col(name), None
        for source, target in rules:
            t = F.lit(None).cast("double") if target is None else F.lit(float(target))
            out = F.when(hit(x, source), t) if out is None else out.when(hit(x, source), t)
        new[to] = out.otherwise(x.cast("double"))
    return df.withColumns(new)


def encode(df: DataFrame, name: str, gen: str, max_labels: int = 65_536) -> tuple[DataFrame, dict[int, str]]:
    """Distinct non-empty strings, sorted, to 1..K, with the value labels; more than max_labels are refused (rc 134)."""
    found = df.select(name).filter(F.col(name) != "").distinct().limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise DataError(134, f"{name} has more than {max_labels} values")
    values = {i: v for i, v in enumerate(sorted(r[0] for r in found), 1)}
    if not values:
        return df.withColumn(gen, F.lit(None).cast("double")), {}
    lookup = F.create_map(*[F.lit(x) for i, v in values.items() for x in (v, float(i))])
    return label(df.withColumn(gen, lookup[F.col(name)]), gen, values=values), values


def decode(df: DataFrame, name: str, gen: str, values: dict | None = None) -> DataFrame:
    """Codes to their label text, empty where there is none."""
    values = values or {float(k): v for k, v in (df.schema[name].metadata or {}).get("values", {}).items()}
    if not values:
        return df.withColumn(gen, F.lit(""))
    lookup = F.create_map(*[F.lit(x) for k, v in values.items() for x in (float(k), v)])
    return df.withColumn(gen, F.coalesce(lookup[F.col(name).cast("double")], F.lit("")))


def destring(df: DataFrame, names: list[str], gen: list[str] | None = None, ignore: str = "", force: bool = False) -> DataFrame:
    """Text to numbers after the ignored characters and blanks are gone; without force, text that is no number is an error (109)."""
    new, bad = {}, []
    for name, to in zip(names, gen or names, strict=True):
        t = F.regexp_replace(F.col(name), r"\s", "")
        t = F.translate(t, ignore, "") if ignore else t
        v = F.when(~t.isin("", ".") & t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
        new[to] = v
        bad.append(F.count_if(v.isNull() & ~F.coalesce(t, F.lit("")).rlike(r"^(\.[a-z]?)?$")).alias(name))
    if not force:
        wrong = [c for c, n in df.agg(*bad).first().asDict().items() if n]
        if wrong:
            raise DataError(109, f"not numeric: {' '.join(wrong)}")
    return df.withColumns(new)


def tostring(df: DataFrame, names: list[str], gen: list[str] | None = None, decimals: int | None = None, force: bool = False) -> DataFrame:
    """Numbers to text; a format that loses digits is an error (109) without force."""
    from tabulon.functions.strings import real, string

    new = {to: string(name, decimals) for name, to in zip(names, gen or names, strict=True)}
    if decimals is not None and not force:
        lost = [F.count_if(F.col(n).isNotNull() & (real(string(n, decimals)) != F.col(n))).alias(n) for n in names]
        wrong = [c for c, k in df.agg(*lost).first().asDict().items() if k]
        if wrong:
            raise DataError(109, f"digits would be lost: {' '.join(wrong)}")
    return df.withColumns(new)


def set_obs(df: DataFrame, n: int) -> DataFrame:
    """Grows the frame to n rows, new cells missing; it cannot shrink."""
    have = df.count()
    if n < have:
        raise DataError(198, "cannot shrink")
    more = df.sparkSession.range(n - have).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(more)


def assert_true(df: DataFrame, test: Column, where: Column | None = None) -> DataFrame:
    """Raises rc 9 if the condition is false in any row; a missing condition passes."""
    bad = df.filter(~test if where is None else (~test & truth(where)))
    if not bad.isEmpty():
        raise DataError(9, "assertion is false")
    return df
