"""Filling missing values from similar records (problem 2).

Numbers are predicted by a mixed-effects model on the log scale,

    ln y = mu + group effect + time effect + error,

both effects random. The variance components come from the one-way analysis of variance by
group and by time (method of moments); each effect is its best linear unbiased predictor, a
mean shrunk by n / (n + s2_error / s2_effect), and the two are fitted together until the time
effects stand still. Categories get a multinomial logit with a group and a time effect on the
log odds, fitted to the count tables by turns, both effects shrunk towards none. Every filled cell carries a mask: ``group`` where the group has the field in
another row, ``time`` where only the period has it.

All sums are taken per (group, time) first and held as one array per group, so a group with a
third of all rows costs its number of periods, not its rows, and a round of the fit moves one
row per period. A period is a calendar year from 1 to 9999, which bounds what reaches the
driver and what is broadcast: the time effects, one row per period.

Defined results: rows without a group are filled from their period, rows without a period
from their group, rows without both stay missing; a group of one missing row is filled from
its period; ties between categories go to the one with more rows, then to the first in order;
input columns are kept as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.session import code, cut

#: Periods are the whole numbers from 1 to this.
LAST_PERIOD = 9_999
#: Weight, in rows, of no effect against a group's or a period's own counts.
PRIOR_ROWS = 1.0
#: Rounds of the numeric fit at most, the change of a time effect (on the log scale) at which it ends, and rounds of the multinomial fit.
MAX_ROUNDS, STILL, FIT_ROUNDS = 20, 1e-4, 3


def is_number(c: str) -> Column:
    return F.coalesce((F.col(c) > 0) & (F.col(c) < 1e12), F.lit(False))


def is_category(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[A-Z]{3}$"), F.lit(False))


class Effects:
    """The fitted mixed model of some numbers: ``u`` (g, u_<c> null where the group lacks c), ``v`` (t, v_<c>), ``mean``."""

    def __init__(self, cells: DataFrame, numbers: list[str]):
        """cells: g, t and the sums n_c, s_c, q_c (rows, logs, squared logs) of each number c."""
        self.numbers, k = numbers, len(numbers)
        sums = [F.sum(f"{a}_{c}").alias(f"{a}_{c}") for c in numbers for a in "nsq"]
        held = F.collect_list(F.struct("t", *[F.col(f"{a}_{c}").cast("double").alias(f"{a}_{c}") for a in "ns" for c in numbers]))
        self.grouped = cut(cells.groupBy("g").agg(held.alias("p"), *sums))
        self._components()
        # the time effects v solve A v = b once the group effects are put in: preconditioned conjugate gradients, a pass each round
        periods, n, b = self._residuals(np.zeros(0, np.int64), np.zeros((0, k)))
        self._time_component(n, b)
        scale, v, r, self.rounds = n + self.ratio_t, np.zeros_like(b), b.copy(), 1
        d = z = r / scale
        while len(periods) and self.rounds < MAX_ROUNDS and float(np.abs(z).max()) >= STILL:
            moved = self._residuals(periods, d)[2]
            ad = scale * d - (moved - b)
            step = np.divide((r * z).sum(axis=0), (d * ad).sum(axis=0), out=np.zeros(k), where=(d * ad).sum(axis=0) > 0)
            v, new = v + step * d, r - step * ad
            turn = np.divide((new * new / scale).sum(axis=0), (r * z).sum(axis=0), out=np.zeros(k), where=(r * z).sum(axis=0) > 0)
            r, z = new, new / scale
            d, self.rounds = z + turn * d, self.rounds + 1
        seen = n > 0
        spark = cells.sparkSession
        rows = [(int(t), *(float(x) if ok else None for x, ok in zip(e, o, strict=True))) for t, e, o in zip(periods, v, seen, strict=True)]
        self.v = spark.createDataFrame(rows, ", ".join(["t int", *(f"v_{c} double" for c in numbers)]))
        self.u = self._pass(periods, v, groups=True)

    def _components(self) -> None:
        parts = []
        for c in self.numbers:
            n, s, q = (F.col(f"{a}_{c}") for a in "nsq")
            parts += [F.sum(n), F.sum(s), F.sum(q), F.count_if(n > 0), F.sum(n * n), F.sum(F.try_divide(s * s, n))]
        r = np.array([float(x or 0) for x in self.grouped.filter("g is not null").agg(*parts).first()]).reshape(-1, 6)
        self.mean, self.error, self.ratio_g = (np.zeros(len(r)) for _ in range(3))
        for i, (N, S, Q, G, NN, B) in enumerate(r):
            self.mean[i] = S / N if N else 0.0
            self.error[i] = max((Q - B) / (N - G), 1e-12) if N > G else 1e-12
            n0 = (N - NN / N) / (G - 1) if G > 1 else 1.0
            between = max(((B - S * S / N) / (G - 1) - self.error[i]) / n0, 0.0) if G > 1 else 1.0
            self.ratio_g[i] = self.error[i] / between if between else 1e12

    def _time_component(self, n: np.ndarray, r: np.ndarray) -> None:
        N, T = n.sum(axis=0), (n > 0).sum(axis=0)
        B = np.divide(r * r, n, out=np.zeros_like(r), where=n > 0).sum(axis=0)
        var = np.maximum((B - T * self.error) / np.maximum(N, 1), 0.0)
        self.ratio_t = np.where(var > 0, self.error / np.where(var > 0, var, 1.0), 1e12)

    def _pass(self, periods: np.ndarray, v: np.ndarray, groups: bool) -> DataFrame:
        """Group effects given the time effects: (g, u_<c>), or what they leave of each period: (t, n, r) in partial sums."""
        k, mean, ratio = len(self.numbers), self.mean, self.ratio_g
        kind = dict(self.grouped.dtypes)["g"]
        names = [f"u_{c}" for c in self.numbers] if groups else [f"{a}_{i}" for a in "nr" for i in range(k)]
        schema = ", ".join([f"g {kind}" if groups else "t int", *(f"{n} double" for n in names)])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column(1)
                size = np.diff(p.offsets.to_numpy())
                flat = p.flatten()
                t = np.asarray(flat.field(0).fill_null(0)).astype(np.int64)
                n, s = (np.column_stack([np.asarray(flat.field(1 + o * k + i)) for i in range(k)]).reshape(-1, k) for o in (0, 1))
                at = np.searchsorted(periods, t)
                effect = np.zeros_like(s)
                if len(periods):
                    hit = (at < len(periods)) & (periods[np.minimum(at, len(periods) - 1)] == t)
                    effect[hit] = v[at[hit]]
                owner = np.repeat(np.arange(len(size)), size)
                rest = s - n * (mean + effect)
                total, count = (np.stack([np.bincount(owner, x[:, i], len(size)) for i in range(k)], axis=1) for x in (rest, n))
                u = total / (count + ratio)
                if groups:
                    cols = [pa.array(u[:, i], mask=count[:, i] == 0) for i in range(k)]
                    yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["g", *names])
                    continue
                u[~np.asarray(b.column(0).is_valid())] = 0.0
                left = s - n * (mean + u[owner])
                dated = t > 0
                found, place = np.unique(t[dated], return_inverse=True)
                sums = [np.bincount(place, x[dated, i], len(found)) for x in (n, left) for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *map(pa.array, sums)], ["t", *names])

        out = self.grouped.select("g", "p").mapInArrow(work, schema)
        return out.filter("g is not null") if groups else out.groupBy("t").agg(*[F.sum(n).alias(n) for n in names])

    def _residuals(self, periods: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.numbers)
        rows = sorted(tuple(r) for r in self._pass(periods, v, groups=False).collect())  # one per period
        a = np.array(rows, float).reshape(len(rows), 1 + 2 * k)
        return a[:, 0].astype(np.int64), a[:, 1 : k + 1], a[:, k + 1 :]


def best_categories(df: DataFrame, c: str) -> DataFrame:
    """(g, t, fill, mask): the most likely category for every (group, period) of g, t, c that misses one.

    A group's candidates are the categories it has; a group that has one needs no model. For
    the others ln odds = ln share + a(g, c) + b(t, c) is fitted by turns: an effect is the log of
    its observed count over the count expected without it, both with PRIOR_ROWS rows added,
    so an effect of which little is known stays near 0.
    """
    have = cut(df.filter(is_category(c)).groupBy("g", "t", F.col(c).alias("c")).agg(F.count("*").alias("n")))
    total = have.agg(F.sum("n")).first()[0] or 1
    share = have.groupBy("c").agg((F.sum("n") / total).alias("share"))
    w = W.partitionBy("g")  # over a row per group and category
    in_group = have.filter("g is not null").groupBy("g", "c").agg(F.sum("n").alias("n_g"))
    in_group = cut(in_group.withColumn("k", F.count("*").over(w)).withColumn("all_g", F.sum("n_g").over(w)).join(share, "c"))
    shrunk = lambda seen, expected: F.ln((seen + PRIOR_ROWS) / (expected + PRIOR_ROWS))
    fit = in_group.filter("k > 1").withColumn("a", shrunk(F.col("n_g"), F.col("share") * F.col("all_g"))).select("g", "c", "n_g", "share", "a")
    b = have.select("t", "c", F.lit(0.0).alias("b")).limit(0)
    if not fit.isEmpty():
        rows = have.filter("g is not null").groupBy("g", "t").agg(F.sum("n").alias("m"))
        seen = have.select(F.col("g").alias("g3"), F.col("t").alias("t3"), F.col("c").alias("c3"), "n")
        x = rows.join(fit, "g")
        x = x.join(seen, (x["g"] == F.col("g3")) & x["t"].eqNullSafe(F.col("t3")) & (x["c"] == F.col("c3")), "left").drop("g3", "t3", "c3").fillna(0, ["n"])
        x = cut(x)
        expected = lambda y: y.withColumn("e", F.exp(F.ln("share") + F.col("a") + F.coalesce("b", F.lit(0.0)))).withColumn("e", F.col("m") * F.col("e") / F.sum("e").over(W.partitionBy("g", "t")))
        for _ in range(FIT_ROUNDS):
            y = expected(x.join(b, ["t", "c"], "left")).filter("t is not null")
            b = cut(y.groupBy("t", "c").agg(shrunk(F.sum("n"), F.sum(F.col("e") / F.exp(F.coalesce("b", F.lit(0.0))))).alias("b")))
            y = expected(x.join(b, ["t", "c"], "left"))
            y = y.withColumn("a", shrunk(F.col("n_g"), F.sum("e").over(W.partitionBy("g", "c")) / F.exp("a")))
            x = cut(y.select("g", "t", "m", "c", "n", "n_g", "share", "a"))
        fit = x.groupBy("g", "c").agg(*[F.max(k).alias(k) for k in ("n_g", "share", "a")])
    need = df.filter(~is_category(c)).select("g", "t").distinct()
    one = need.join(in_group.filter("k = 1").select("g", F.col("c").alias("fill")), "g").select("g", "t", "fill")
    cand = need.join(fit, "g").join(b, ["t", "c"], "left")
    score = F.ln("share") + F.col("a") + F.coalesce("b", F.lit(0.0))
    many = cand.groupBy("g", "t").agg(F.min_by("c", F.struct((-F.round(score, 9)).alias("s"), (-F.col("n_g")).alias("n"), "c")).alias("fill"))
    alone = need.join(in_group.select("g").distinct(), "g", "left_anti").filter("t is not null")
    in_time = have.filter("t is not null").groupBy("t", "c").agg(F.sum("n").alias("n_t"))
    top = in_time.groupBy("t").agg(F.min_by("c", F.struct((-F.col("n_t")).alias("n"), "c")).alias("fill"))
    by_time = alone.join(top, "t").select("g", "t", "fill")
    return one.unionByName(many).withColumn("mask", F.lit("group")).unionByName(by_time.withColumn("mask", F.lit("time")))


def mixed_fill(df: DataFrame, group: Column, time: Column, numbers: list[str], categories: list[str] = ()) -> DataFrame:
    """df with ``<c>_filled`` (the value, or its prediction) and ``<c>_mask`` (null, ``group`` or ``time``) for every field.

    time is a whole number; values outside 1 to LAST_PERIOD are no period.
    """
    time = F.when(time.between(1, LAST_PERIOD), time.cast("int"))
    logs = {c: F.when(is_number(c), F.ln(F.col(c))) for c in numbers}
    sums = [a for c, y in logs.items() for a in (F.count(y).alias(f"n_{c}"), F.coalesce(F.sum(y), F.lit(0.0)).alias(f"s_{c}"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias(f"q_{c}"))]
    model = Effects(df.select(group.alias("g"), time.alias("t"), *numbers).groupBy("g", "t").agg(*sums), numbers)
    keyed = df.select(group.alias("g"), time.alias("t"), *numbers, *categories)
    lacks = F.lit(False)
    for c in numbers:
        lacks = lacks | ~is_number(c)
    for c in categories:
        lacks = lacks | ~is_category(c)
    # what every (group, period) with a gap is filled with, joined to the rows once
    fills = keyed.filter(lacks).select("g", "t").distinct().join(model.u, "g", "left").join(F.broadcast(model.v), "t", "left")
    for c in categories:
        best = best_categories(keyed.select("g", "t", c), c).select(F.col("g").alias("g2"), F.col("t").alias("t2"), F.col("fill").alias(f"fill_{c}"), F.col("mask").alias(f"mask_{c}"))
        fills = fills.join(best, fills["g"].eqNullSafe(best["g2"]) & fills["t"].eqNullSafe(best["t2"]), "left").drop("g2", "t2")
    fills = fills.select(*[F.col(c).alias(f"__{c}") for c in fills.columns])
    # structs are equal where their fields are, missing ones included; complete rows match nothing, and their hash spreads them over the tasks
    spread = F.when(lacks, None).otherwise(F.xxhash64(*[F.col(c) for c in (*numbers, *categories)], time))
    x = df.withColumn("__gap", F.struct(group.alias("g"), time.alias("t"), spread.alias("whole")))
    x = x.join(fills.withColumn("__gap", F.struct(F.col("__g").alias("g"), F.col("__t").alias("t"), F.lit(None).cast("bigint").alias("whole"))), "__gap", "left")
    new = {}
    for i, c in enumerate(numbers):
        ug, vt = F.col(f"__u_{c}"), F.col(f"__v_{c}")
        mask = F.when(~is_number(c), F.when(ug.isNotNull(), "group").when(vt.isNotNull(), "time"))
        predicted = F.exp(F.lit(float(model.mean[i])) + F.coalesce(ug, F.lit(0.0)) + F.coalesce(vt, F.lit(0.0)))
        new[f"{c}_filled"] = F.when(is_number(c), F.col(c)).when(mask.isNotNull(), predicted)
        new[f"{c}_mask"] = mask
    for c in categories:
        new[f"{c}_filled"] = F.when(is_category(c), F.col(c)).otherwise(F.col(f"__fill_{c}"))
        new[f"{c}_mask"] = F.when(~is_category(c), F.col(f"__mask_{c}"))
    return x.withColumns(new).select(*df.columns, *new)


def year_of(c: str) -> Column:
    x = F.col(c)
    return F.when(~F.isnan(x) & (x == F.floor(x)) & x.between(1, 9999), x.cast("int"))


def fill_panel(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """panel with gdp, pop and currency filled; the group is the territory, if ``regions`` knows it at any time."""
    known = regions.select(code("country").alias("__known")).filter("__known is not null").distinct()
    p = panel.withColumn("__c", code("country")).join(known, F.col("__c") == F.col("__known"), "left")
    out = mixed_fill(p, F.col("__known"), year_of("year"), ["gdp", "pop"], ["currency"])
    return out.drop("__c", "__known")


def fill_grunfeld(grunfeld: DataFrame) -> DataFrame:
    """grunfeld with invest filled; the group is the firm."""
    firm = F.when(~F.isnan("firm"), F.col("firm"))
    return mixed_fill(grunfeld, firm, year_of("year"), ["invest"])


def found(panel: DataFrame, regions: DataFrame, grunfeld: DataFrame) -> DataFrame:
    """(tbl, row_id, fld): cells filled from their group."""

    def marks(df: DataFrame, tbl: str, flds: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.when(F.col(f"{f}_mask") == "group", f) for f in flds]))
        return df.select(F.lit(tbl).alias("tbl"), "row_id", each.alias("fld")).filter("fld is not null")

    return marks(fill_panel(panel, regions), "panel", ["gdp", "pop", "currency"]).unionByName(marks(fill_grunfeld(grunfeld), "grunfeld", ["invest"]))
