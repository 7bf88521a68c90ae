"""By-group and time-series operators.

Windows are partitioned by the group or the panel. A global row number needs no single
partition: rows are range-partitioned by the order key and numbered from per-partition
counts, of which there are as many as partitions.
"""

from __future__ import annotations

import functools
import itertools
import re
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions.missing import truth
from tabulon.operators.prep import DataError
from tabulon.session import cut


def ordering(*keys: str | Column) -> list[Column]:
    """Ascending, missing last; '-name' descending, missing first."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
        else:
            out.append(F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last())
    return out


class By:
    """by group (order): expressions within groups, for use in ``withColumn``."""

    def __init__(self, *groups: str, order: list | tuple = ()):
        self.all = W.partitionBy(*groups)
        self.window = self.all.orderBy(*ordering(*order)) if order else self.all

    def n(self) -> Column:
        """Position in the group, from 1."""
        return F.row_number().over(self.window)

    def N(self) -> Column:
        return F.count("*").over(self.all)

    def running_sum(self, x: Column, where: Column | None = None) -> Column:
        """Missing counts as 0; only selected rows count."""
        x = F.coalesce(x, F.lit(0.0))
        x = x if where is None else F.when(truth(where), x).otherwise(0.0)
        return F.sum(x).over(self.window.rowsBetween(W.unboundedPreceding, 0))

    def at(self, x: Column, shift: int) -> Column:
        """x[_n + shift]; outside the group it is missing."""
        return F.lead(x, shift).over(self.window) if shift > 0 else F.lag(x, -shift).over(self.window) if shift else x

    def first(self, x: Column) -> Column:
        return F.first(x).over(self.window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def last(self, x: Column) -> Column:
        return F.last(x).over(self.window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def nth(self, x: Column, k: int) -> Column:
        return F.nth_value(x, k).over(self.window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def numbered(df: DataFrame, *keys: str, name: str = "_n") -> DataFrame:
    """A dense row number over the whole frame in the order of the keys, without a single-partition window.

    The range bounds are sampled anew in each run, so the partitions are written once and both
    the counts and the rows are read from there.
    """
    part = df.repartitionByRange(*ordering(*keys)).sortWithinPartitions(*ordering(*keys)).withColumn("__p", F.spark_partition_id())
    part = cut(part.withColumn("__m", F.monotonically_increasing_id()))
    sizes = part.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__lo"))
    starts = {r["__p"]: (r["__c"], r["__lo"]) for r in sizes.collect()}  # one pair per partition
    at, offset = {}, 0
    for p in sorted(starts):
        at[p] = offset - starts[p][1]
        offset += starts[p][0]
    if not at:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    lookup = F.create_map(*[F.lit(v) for p, o in at.items() for v in (p, o)])
    return part.withColumn(name, F.col("__m") + lookup[F.col("__p")] + 1).drop("__p", "__m")


def in_range(df: DataFrame, first: int, last: int | None, *keys: str) -> DataFrame:
    """Rows first to last (None: the end) in the order of the keys; from the first row on it is a top-k."""
    if first == 1 and last is not None:
        return df.orderBy(*ordering(*keys)).limit(last)
    n = numbered(df, *keys)
    n = n.filter(F.col("_n") >= first)
    return (n if last is None else n.filter(F.col("_n") <= last)).drop("_n")


def group_id(df: DataFrame, names: list[str], name: str = "group") -> DataFrame:
    """1..K by sorted tuple: the distinct tuples are numbered and joined back, missing last."""
    ids = numbered(df.select(*names).distinct(), *names, name=name).select(*[F.col(n).alias(f"__{n}") for n in names], name)
    same = [df[n].eqNullSafe(ids[f"__{n}"]) for n in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(ids, on, "left").drop(*[f"__{n}" for n in names])


def egen(stat: str, x: Column, by: list[str], where: Column | None = None, p: float = 50) -> Column:
    """A group statistic given to every selected row of the group.

    mean sum total count min max sd var median p50, pc (linear rule, p), p25 p75 iqr (nearest
    rank), rank (average of ties). Of these p25, p75 and iqr sort the group for each of its rows,
    so they are for small groups; ``egen_join`` and ``egen_rank`` are for any.
    """
    w = W.partitionBy(*by)
    x = x.cast("double")
    v = x if where is None else F.when(truth(where), x)

    def nearest(q: int) -> Column:
        s = F.sort_array(F.collect_list(v).over(w))
        return F.try_element_at(s, (F.floor(q * (F.size(s) - 1) / 4) + 1).cast("int"))

    simple = {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "sd": F.stddev_samp, "var": F.var_samp}
    if stat in simple:
        out = simple[stat](v).over(w).cast("double")
    elif stat in ("sum", "total"):
        out = F.coalesce(F.sum(v).over(w), F.lit(0.0))
    elif stat in ("median", "p50", "pc"):
        out = F.percentile(v, F.lit(p / 100 if stat == "pc" else 0.5)).over(w)
    elif stat in ("p25", "p75"):
        out = nearest(1 if stat == "p25" else 3)
    elif stat == "iqr":
        out = nearest(3) - nearest(1)
    elif stat == "rank":
        out = F.when(v.isNotNull(), F.rank().over(w.orderBy(v.asc_nulls_last())) + (F.count("*").over(W.partitionBy(*by, v)) - 1) / 2)
    else:
        raise DataError(133, f"unknown egen function {stat}")
    return out if where is None else F.when(truth(where), out)


def egen_join(df: DataFrame, stats: dict[str, tuple[str, str]], by: list[str], rule: str = "linear") -> DataFrame:
    """Group statistics given to every row, as an aggregate joined back.

    ``egen`` is a window, which brings a whole group to one task; here a group that holds a
    third of all rows is aggregated on the map side and its rows are joined where adaptive
    execution may split them. Names map to (statistic, column) as in ``collapse``; ``rule`` is
    that of percentiles, "nearest" for those of ``egen``.
    """
    from tabulon.operators.aggregate import collapse

    g = collapse(df, stats, by, rule=rule).select(F.struct(*by).alias("__k"), *stats)
    return df.withColumn("__k", F.struct(*by)).join(g, "__k", "left").drop("__k")


def egen_rank(df: DataFrame, name: str, by: list[str], new: str) -> DataFrame:
    """The rank in the group, the average of ties, without bringing a group to one task; missing where the value is."""
    from tabulon.operators.aggregate import ranks

    r = ranks(df, by, name).select(F.col("k").alias("__k"), F.col("x").alias("__x"), F.col("r").alias(new))
    return df.withColumns({"__k": F.struct(*by), "__x": F.col(name).cast("double")}).join(r, ["__k", "__x"], "left").drop("__k", "__x")


def tag(by: list[str], order: list[str]) -> Column:
    """1 in the first row of each group, else 0."""
    return (F.row_number().over(W.partitionBy(*by).orderBy(*ordering(*order))) == 1).cast("double")


def row_stat(stat: str, *names: str) -> Column:
    """rowtotal rowmean rowmin rowmax rowsd rowmiss rownonmiss over columns of one row."""
    cs = [F.col(n).cast("double") for n in names]
    zero = F.lit(0.0)
    n = sum((c.isNotNull().cast("double") for c in cs), zero)
    total = sum((F.coalesce(c, zero) for c in cs), zero)
    if stat == "rowmiss":
        return F.lit(float(len(cs))) - n
    if stat == "rowsd":
        mean = F.try_divide(total, n)
        return F.sqrt(F.try_divide(sum((F.coalesce((c - mean) * (c - mean), zero) for c in cs), zero), F.when(n > 1, n - 1)))
    many = {"rowmin": F.least, "rowmax": F.greatest}
    if stat in many:
        return many[stat](*cs) if len(cs) > 1 else cs[0]
    return {"rowtotal": total, "rowmean": F.try_divide(total, n), "rownonmiss": n}[stat]


class Panel:
    """tsset / xtset: gap-aware operators by the value of time within a panel.

    A lag is the value at time t - k, found in a range frame; a gap gives a missing value, a
    missing time too. Where a time occurs twice in a panel, the first row by ``order`` counts.
    """

    def __init__(self, time: str, panel: str | None = None, order: Column | None = None):
        self.time, self.order = F.col(time), order
        self.base = (W.partitionBy(panel) if panel else W.partitionBy(F.lit(1))).orderBy(time)

    def L(self, x: Column, k: int = 1) -> Column:
        if k == 0:
            return x
        frame = self.base.rangeBetween(-k, -k)
        got = F.first(x).over(frame) if self.order is None else F.min_by(x, self.order).over(frame)
        return F.when(self.time.isNotNull(), got)

    def F(self, x: Column, k: int = 1) -> Column:
        return self.L(x, -k)

    def D(self, x: Column, k: int = 1) -> Column:
        """k-th difference."""
        out = x
        for i in range(1, k + 1):
            out = out + self.L(x, i) * ((-1) ** i * comb(k, i))
        return out

    def S(self, x: Column, k: int = 1) -> Column:
        """x[t] - x[t-k]."""
        return x - self.L(x, k)

    def expand(self, spec: str) -> dict[str, Column]:
        """Columns of an operator list, by name: ``D.x``, ``L(1/3).x``, ``L.(x y)``, and chains such as ``L(1/2)D.x``, every combination of which is a column."""
        held = r"\d+|\((?:[^()]|\(\d+\))*\)"
        m = re.fullmatch(rf"((?:[LFDSlfds](?:{held})?)+)\.(\w+|\([\w ]+\))", spec)
        if not m:
            raise DataError(198, f"bad operator list {spec}")
        ops = [(op.upper(), self.orders(ks)) for op, ks in re.findall(rf"([A-Za-z])({held})?", m[1])]
        out: dict[str, Column] = {}
        for x in m[2].strip("()").split():
            for ks in itertools.product(*[k for _, k in ops]):
                name, shifts = "", {0: 1}  # a chain is a sum of lags with whole weights
                for (op, _), k in zip(ops, ks, strict=True):
                    name += f"{op}{k if k > 1 else ''}" if k else ""
                    own = {"L": {k: 1}, "F": {-k: 1}, "S": {0: 1, k: -1} if k else {0: 1}, "D": {i: (-1) ** i * comb(k, i) for i in range(k + 1)}}[op]
                    new: dict[int, int] = {}
                    for i, a in shifts.items():
                        for j, b in own.items():
                            new[i + j] = new.get(i + j, 0) + a * b
                    shifts = new
                parts = [self.L(F.col(x), i) * a if a != 1 else self.L(F.col(x), i) for i, a in sorted(shifts.items())]
                out[f"{name}.{x}" if name else x] = functools.reduce(lambda p, q: p + q, parts)
        return out

    @staticmethod
    def orders(text: str) -> list[int]:
        """The orders of one operator: none is 1; in brackets single ones, a/b and a(step)b."""
        ks: list[int] = []
        for part in text.removeprefix("(").removesuffix(")").split() if text else ["1"]:
            if r := re.fullmatch(r"(\d+)/(\d+)", part):
                ks += range(int(r[1]), int(r[2]) + 1)
            elif r := re.fullmatch(r"(\d+)\((\d+)\)(\d+)", part):
                ks += range(int(r[1]), int(r[3]) + 1, int(r[2]))
            else:
                ks.append(int(part))
        return ks


def check_panel(df: DataFrame, time: str, panel: str | None = None) -> DataFrame:
    """Raises rc 451 if a time occurs twice in a panel."""
    keys = [k for k in (panel, time) if k]
    if not df.filter(F.col(time).isNotNull()).groupBy(*keys).count().filter("count > 1").isEmpty():
        raise DataError(451, "repeated time values within panel")
    return df
