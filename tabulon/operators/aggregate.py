"""Group summaries. All are partial aggregations; percentiles come in three documented conventions:

``linear`` interpolates at p(n-1), ``nearest`` takes the order statistic at floor(p(n-1)),
``np1`` interpolates at p(n+1)/100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions.missing import truth
from tabulon.operators.prep import DataError

QUANTILES = {"median": 0.5, **{f"p{p}": p / 100 for p in range(1, 100)}}


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both; missing where one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def statistic(stat: str, x: Column, w: Column | None = None, order: Column | None = None) -> Column:
    """One statistic of x, skipping missings; w weights it, order says what first and last mean."""
    x = x.cast("double")
    if stat in ("first", "last"):
        if order is None:
            raise DataError(198, "first and last need an order")
        return (F.min_by if stat == "first" else F.max_by)(x, F.when(x.isNotNull(), order))
    if stat in ("count", "n", "N"):
        return F.count(x).cast("double")
    if is_quantile(stat):
        raise DataError(198, "percentiles come from quantiles()")
    if stat in ("max", "min", "range"):
        return {"max": F.max(x), "min": F.min(x), "range": F.max(x) - F.min(x)}[stat]
    if w is None:
        plain = {"mean": F.avg, "sd": F.stddev_samp, "var": F.var_samp}
        if stat in plain:
            return plain[stat](x)
        if stat == "sum":
            return F.coalesce(F.sum(x), F.lit(0.0))
        if stat == "cv":
            return F.try_divide(F.stddev_samp(x), F.avg(x))
        raise DataError(198, f"unknown statistic {stat}")
    sw, swx, swxx = (F.sum(F.when(x.isNotNull(), v)) for v in (w, w * x, w * x * x))
    if stat == "mean":
        return F.try_divide(swx, sw)
    if stat == "sum":
        return F.coalesce(swx, F.lit(0.0))
    var = F.try_divide(swxx - F.try_divide(swx * swx, sw), sw - 1)
    if stat in ("var", "sd"):
        return var if stat == "var" else F.sqrt(F.greatest(var, F.lit(0.0)))
    if stat == "cv":
        return F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.try_divide(swx, sw))
    raise DataError(198, f"unknown statistic {stat}")


#: Buckets into which ``order_stats`` cuts the values of a group.
BUCKETS = 32


def _key(by: list[str]) -> Column:
    """The group as one struct: structs are equal where their fields are, missing ones included."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def _buckets(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows k, v, x, w: (k, v, x, c, b), the distinct values with counts and buckets, and (k, v, b, m, start, n), the buckets with rows in and before them."""
    number = F.when(~F.isnan("x"), F.col("x"))  # NaN is above every cut
    cuts = x.groupBy("k", "v").agg(F.percentile_approx(number, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("cuts"), F.sum("w").alias("n"))
    d = x.groupBy("k", "v", "x").agg(F.sum("w").alias("c")).join(cuts, ["k", "v"])
    d = d.select("k", "v", "x", "c", "n", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda q: q < F.col("x")))).alias("b"))
    w = W.partitionBy("k", "v").orderBy("b")  # at most BUCKETS rows a group
    size = d.groupBy("k", "v", "n", "b").agg(F.sum("c").alias("m")).withColumn("start", F.sum("m").over(w) - F.col("m"))
    return d, size


def _place(p: float, rule: str) -> tuple[Column, Column, Column]:
    """Ranks from 0 of the values below and above the p-quantile of n rows, and the share of the upper one."""
    n = F.col("n")
    if rule == "np1":
        h = n.cast("double") * p + p  # position from 1
        k = F.greatest(F.lit(1), F.least(F.floor(h), n))
        return k - 1, F.least(k, n - 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), h - k))
    h = F.lit(p) * (n - 1)
    low = F.floor(h)
    if rule == "nearest":
        return low, low, F.lit(0.0)
    if rule != "linear":
        raise DataError(198, f"unknown percentile rule {rule}")
    return low, F.least(low + 1, n - 1), h - low


def order_stats(df: DataFrame, by: list[str], columns: list[str], ps: list[float], rule: str = "linear", weight: Column | None = None) -> DataFrame:
    """(k, v, p0, p1, ...): exact percentiles by a rule (linear, nearest, np1) of each column v in each group k; a weight counts a row so many times.

    No group is ever sorted, or hashed, in one task: repeated values are counted first, the
    distinct values of a group are cut into BUCKETS at approximate quantiles, and only the
    buckets that hold a wanted rank are ordered.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("v"), F.col(c).cast("double").alias("x")) for c in columns]))
    x = df.select(_key(by).alias("k"), (F.lit(1) if weight is None else weight).alias("w"), pair.alias("p")).select("k", "p.v", "p.x", "w").filter("x is not null and not isnan(x)")
    d, size = _buckets(x)
    low, high, share = zip(*[_place(p, rule) for p in ps], strict=True)
    wanted = F.exists(F.array(*low, *high), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("m")))
    hit = d.join(size.filter(wanted).select("k", "v", "b", "start"), ["k", "v", "b"])
    hit = hit.withColumn("hi", F.col("start") + F.sum("c").over(W.partitionBy("k", "v", "b").orderBy("x"))).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda r: F.max(F.when((F.col("lo") <= r) & (F.col("hi") > r), F.col("x")))
    value = [at(a) + F.max(s) * (at(b) - at(a)) for a, b, s in zip(low, high, share, strict=True)]
    return hit.groupBy("k", "v").agg(*[v.alias(f"p{i}") for i, v in enumerate(value)])


def ranks(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(k, x, r): the rank of each distinct value x in each group k, the average of its ties, from the counts of the buckets below and of the values below in its own."""
    d, size = _buckets(df.select(_key(by).alias("k"), F.lit(name).alias("v"), F.col(name).cast("double").alias("x"), F.lit(1).alias("w")).filter("x is not null"))
    d = d.join(size.select("k", "v", "b", "start"), ["k", "v", "b"])
    hi = F.col("start") + F.sum("c").over(W.partitionBy("k", "v", "b").orderBy("x"))
    return d.select("k", "x", (hi - F.col("c") + (F.col("c") + 1) / 2).alias("r"))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, str]], rule: str = "linear", weight: Column | None = None) -> DataFrame:
    """(k, one column per name): ``wanted`` maps a name to (median, p1 to p99 or iqr, column)."""
    levels = lambda s: [0.25, 0.75] if s == "iqr" else [QUANTILES[s]]
    ps = sorted({p for s, _ in wanted.values() for p in levels(s)})
    o = order_stats(df, by, sorted({c for _, c in wanted.values()}), ps, rule, weight)
    pick = lambda c, p: F.max(F.when(F.col("v") == c, F.col(f"p{ps.index(p)}")))
    cols = [(pick(c, 0.75) - pick(c, 0.25) if s == "iqr" else pick(c, QUANTILES[s])).alias(n) for n, (s, c) in wanted.items()]
    return o.groupBy("k").agg(*cols)


def is_quantile(stat: str) -> bool:
    return stat in QUANTILES or stat == "iqr"


def collapse(df: DataFrame, stats: dict[str, tuple[str, str]], by: list[str] = (), weight: str | None = None, where: Column | None = None, order: Column | None = None, rule: str = "linear") -> DataFrame:
    """``stats``: new name to (statistic, column). A missing group key forms a group; without ``by`` one row. ``rule`` is that of percentiles. A weight counts a row so many times in every statistic but count, min, max, first and last; rows without a positive weight are left out."""
    if where is not None:
        df = df.filter(where)
    w = None
    if weight is not None:
        df = df.filter(F.col(weight) > 0)
        w = F.col(weight).cast("double")
    wanted = {n: sc for n, sc in stats.items() if is_quantile(sc[0])}
    cols = [statistic(s, F.col(c), w, order).alias(n) for n, (s, c) in stats.items() if n not in wanted]
    if not wanted:
        return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    base = df.groupBy(*by).agg(*(cols or [F.count("*").alias("__n")])) if by else df.agg(*(cols or [F.count("*").alias("__n")]))
    out = base.withColumn("k", _key(by)).join(quantiles(df, by, wanted, rule, w), "k", "left")
    return out.select(*by, *stats)


def summarize(df: DataFrame, names: list[str], by: list[str] = (), weight: str | None = None, kind: str = "aweight", detail: bool = False) -> DataFrame:
    """One row per variable (and group): n, mean, sd, min, max, sum and, with detail, percentiles, variance, skewness, kurtosis.

    fweight counts rows w times; aweight and iweight are scaled to the number of rows; rows
    with a missing or non-positive weight are left out.
    """
    if weight is not None:
        df = df.filter(F.col(weight) > 0)
    keep = [*by, *names, *([weight] if weight else [])]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("x")) for n in names]))
    x = df.select(*dict.fromkeys(keep)).select(*by, *([F.col(weight).cast("double").alias("__w")] if weight else []), pairs.alias("p")).select(*by, *(["__w"] if weight else []), "p.variable", "p.x").filter("x is not null")
    v = F.col("x")
    if weight is None:
        cols = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")]
    else:
        w = F.col("__w")
        n = F.sum(w) if kind == "fweight" else F.count(v).cast("double")
        scale = F.lit(1.0) if kind == "fweight" else n / F.sum(w)
        ss = scale * (F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / F.sum(w))
        cols = [n.cast("bigint").alias("n"), (F.sum(w * v) / F.sum(w)).alias("mean"), F.sqrt(F.greatest(F.try_divide(ss, n - 1), F.lit(0.0))).alias("sd")]
    cols += [F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v) if weight is None else F.sum(F.col("__w") * v)).alias("sum")]
    if detail:
        ps = (1, 5, 10, 25, 50, 75, 90, 95, 99)
        if weight is None:
            n = F.count(v)
            cols += [F.var_samp(v).alias("variance"), (F.skewness(v) * F.pow(F.try_divide(n - 1, n), F.lit(1.5))).alias("skewness"), ((F.kurtosis(v) + 3) * F.pow(F.try_divide(n - 1, n), F.lit(2))).alias("kurtosis")]
        else:
            m1, m2, m3, m4 = (F.sum(w * F.pow(v, F.lit(k))) / F.sum(w) for k in range(1, 5))
            var = F.greatest(F.try_divide(ss, n - 1), F.lit(0.0))
            third = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
            fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
            cols += [var.alias("variance"), F.try_divide(third, F.pow(var, F.lit(1.5))).alias("skewness"), F.try_divide(fourth, var * var).alias("kurtosis")]
        counted = None if weight is None else F.col(weight).cast("double")
        if weight is not None and kind != "fweight":  # scaled to the rows of its group
            df = df.join(df.groupBy(_key(by).alias("__k")).agg((F.count("*") / F.sum(weight)).alias("__s")), _key(by) == F.col("__k"))
            counted = counted * F.col("__s")
        q = order_stats(df, by, names, [p / 100 for p in ps], weight=counted).select("k", F.col("v").alias("variable"), *[F.col(f"p{i}").alias(f"p{p}") for i, p in enumerate(ps)])
        out = x.groupBy(*by, "variable").agg(*cols).withColumn("k", _key(by))
        return out.join(q, ["k", "variable"], "left").drop("k")
    return x.groupBy(*by, "variable").agg(*cols)


def extremes(df: DataFrame, name: str, k: int = 4) -> DataFrame:
    """The k smallest and k largest values: side, rank, value. Both are top-k plans, no full sort."""
    x = df.select(F.col(name).cast("double").alias("value")).filter("value is not null")
    low, high = x.orderBy("value").limit(k), x.orderBy(F.desc("value")).limit(k)
    number = lambda d, side, by: d.select(F.lit(side).alias("side"), F.row_number().over(W.partitionBy(F.lit(1)).orderBy(by)).alias("rank"), "value")  # noqa: E731 over k rows
    return number(low, "smallest", "value").unionByName(number(high, "largest", F.desc("value")))


def count(df: DataFrame, where: Column | None = None, by: list[str] = (), fweight: str | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    n = F.count("*") if fweight is None else F.coalesce(F.sum(F.col(fweight)), F.lit(0))
    return df.groupBy(*by).agg(n.alias("n")) if by else df.agg(n.alias("n"))


def tabulate(df: DataFrame, *names: str, weight: str | None = None, missing: bool = True) -> DataFrame:
    """Frequencies and percent of one variable or of the cells of several; missing is a category."""
    if not missing:
        df = df.dropna(subset=list(names))
    freq = F.count("*") if weight is None else F.sum(F.col(weight))
    t = df.groupBy(*names).agg(freq.alias("freq"))
    total = F.sum("freq").over(W.partitionBy(F.lit(1)))  # over one row per category
    return t.withColumn("percent", F.col("freq") * 100.0 / total)


def tabstat(df: DataFrame, names: list[str], stats: list[str], by: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per group and a total row (is_total = 1), columns <name>_<stat>; a weight counts a row so many times."""
    w = None if weight is None else F.col(weight).cast("double")
    df = df if weight is None else df.filter(F.col(weight) > 0)
    pairs = [(n, s) for n in names for s in stats]
    cols = [statistic(s, F.col(n), w).alias(f"{n}_{s}") for n, s in pairs if not is_quantile(s)]
    ranks = {f"{n}_{s}": (s, n) for n, s in pairs if is_quantile(s)}
    order = [f"{n}_{s}" for n, s in pairs]
    if by is None:
        return collapse(df, {f"{n}_{s}": (s, n) for n, s in pairs}, weight=weight)
    base = df.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), *cols)
    if ranks:
        none = F.struct(F.lit(None).cast(dict(df.dtypes)[by]).alias(by))
        q = quantiles(df, [by], ranks, weight=w).withColumn("is_total", F.lit(0)).unionByName(quantiles(df, [], ranks, weight=w).withColumn("k", none).withColumn("is_total", F.lit(1)))
        base = base.withColumn("k", F.struct(by)).join(q, ["k", "is_total"], "left")
    return base.select(by, "is_total", *order)


def codebook(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per variable: type, rows, missing, distinct, min, max, mean (numbers only)."""
    kinds = dict(df.dtypes)
    rows = []
    for n in names:
        numeric = kinds[n] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[n].startswith("decimal")
        text, x = F.col(n).cast("string"), F.col(n).cast("double") if numeric else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(n).alias("variable"), F.lit("numeric" if numeric else "string").alias("kind"), (text if numeric else F.when(text != "", text)).alias("v"), x.alias("x")))
    # repeated values are counted first, so one scan and two aggregates serve all variables
    per = df.select(F.inline(F.array(*rows))).groupBy("variable", "kind", "v", "x").agg(F.count("*").alias("c"))
    mean = F.try_divide(F.sum(F.col("x") * F.col("c")), F.sum(F.when(F.col("x").isNotNull(), F.col("c"))))
    return per.groupBy("variable", "kind").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_distinct"), F.min("x").alias("min"), F.max("x").alias("max"), mean.alias("mean"))


def describe(df: DataFrame) -> DataFrame:
    """One row per column in order: position, name, type (double or str as shown to users), label."""
    from pyspark.sql import types as T

    rows = [(i, f.name, "str" if isinstance(f.dataType, T.StringType) else f.dataType.simpleString(), (f.metadata or {}).get("label")) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, label string")


def xtdescribe(df: DataFrame, panel: str, time: str) -> DataFrame:
    """Panels, observations, time span, the distribution of the panels' lengths, and whether all are equal."""
    per = df.filter(F.col(panel).isNotNull() & F.col(time).isNotNull()).groupBy(panel).agg(F.count("*").alias("t"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    q = F.percentile("t", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = per.agg(F.count("*").alias("n_panels"), F.sum("t").alias("n_obs"), F.min("lo").alias("first_t"), F.max("hi").alias("last_t"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("t").alias("t_mean"), q.alias("q"))
    return out.select("n_panels", "n_obs", "first_t", "last_t", "t_min", *[F.col("q")[i].alias(f"t_p{p}") for i, p in enumerate((5, 25, 50, 75, 95))], "t_max", "t_mean", (F.col("t_min") == F.col("t_max")).cast("int").alias("balanced"))


def isid(df: DataFrame, names: list[str]) -> DataFrame:
    """Raises rc 459 unless the names identify every row."""
    if not df.groupBy(*names).count().filter("count > 1").isEmpty():
        raise DataError(459, f"{' '.join(names)} do not uniquely identify the rows")
    return df


def duplicates_report(df: DataFrame, names: list[str]) -> DataFrame:
    """copies, rows and surplus rows for each number of copies."""
    return df.groupBy(*names).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.sum("copies").alias("n_rows"), F.sum(F.col("copies") - 1).alias("surplus"))


def duplicates_drop(df: DataFrame, names: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; an aggregate, so repeats shrink before the shuffle."""
    row = F.struct(*df.columns)
    first = df.groupBy(*[F.col(n).alias(f"__{n}") for n in names]).agg(F.min_by(row, F.struct(*order)).alias("__r"))
    return first.select("__r.*")


def pwcorr(df: DataFrame, names: list[str]) -> DataFrame:
    """Pairwise-complete correlations, one row per pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    structs = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), correlation(F.col(a), F.col(b)).alias("rho"), F.count(both(a, b, a)).alias("n")) for a, b in pairs]
    return df.agg(F.array(*structs).alias("p")).select(F.inline("p"))


def histogram_bins(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins: bin, lower, width, freq; by default min(ceil(sqrt(n)), 50) bins."""
    x = df.select(F.col(name).cast("double").alias("x")).filter("x is not null")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return x.select(F.lit(0).alias("bin"), F.col("x").alias("lower"), F.col("x").alias("width"), F.lit(0).cast("bigint").alias("freq")).limit(0)
    k = bins or min(int(-(-(n**0.5) // 1)), 50)
    width = (hi - lo) / k or 1.0
    b = F.least(F.floor((F.col("x") - lo) / width), F.lit(k - 1)).cast("int")
    return x.groupBy(b.alias("bin")).agg(F.count("*").alias("freq")).select("bin", (F.col("bin") * width + lo).alias("lower"), F.lit(width).alias("width"), "freq")


def box_stats(df: DataFrame, name: str, over: list[str] = ()) -> DataFrame:
    """Quartiles by the np1 rule, adjacent values and the number of outliers, per group; NaN is missing.

    The quartiles come from ``order_stats`` and are joined to the rows, the rest is one aggregate.
    """
    over = list(over)
    x = df.select(*over, F.col(name).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    q = order_stats(x, over, ["x"], [0.25, 0.5, 0.75], "np1").select("k", F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))
    j = x.withColumn("k", _key(over)).join(q, "k")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - fence, F.col("q3") + fence)
    out = j.groupBy("k").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("q1", "median", "q3")], F.min(F.when(inside, F.col("x"))).alias("lower_adjacent"), F.max(F.when(inside, F.col("x"))).alias("upper_adjacent"), F.count_if(~inside).alias("n_outside"))
    return out.select(*[F.col("k")[c].alias(c) for c in over], *[c for c in out.columns if c != "k"])


def where_true(df: DataFrame, p: Column) -> DataFrame:
    return df.filter(truth(p))
