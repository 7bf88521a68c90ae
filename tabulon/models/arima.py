"""ARIMA(p, d, q) with regressors for any number of series at once.

The conditional sum of squares is a recursion along time, so every series is fitted in one
group; a series longer than MAX_LENGTH would be an unbounded group and is fitted instead by
the two-stage regression ``long_series`` (a long autoregression gives the errors, whose lags
then are regressors), which is windows and TSQR only and runs on any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.models.linear import Estimates, regress
from tabulon.operators.aggregate import correlation
from tabulon.operators.prep import DataError
from tabulon.operators.window import Panel
from tabulon.session import cut

MAX_LENGTH = 100_000


def series_errors(z: np.ndarray, b: np.ndarray, p: int, q: int, constant: bool) -> np.ndarray:
    """Conditional errors of z given the parameters; those before the first full lag are 0."""
    c, ar, ma = (b[0], b[1 : p + 1], b[p + 1 :]) if constant else (0.0, b[:p], b[p:])
    w = z - c
    base = w.copy()
    for i, a in enumerate(ar, 1):
        base[i:] -= a * w[:-i]
    if not q:
        base[:p] = 0
        return base
    e = np.zeros(len(z))
    for t in range(p, len(z)):
        s = base[t]
        for k, m in enumerate(ma, 1):
            if t >= k:
                s -= m * e[t - k]
        e[t] = s
    return e


def fit(z: np.ndarray, p: int, q: int, constant: bool = True, X: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(b, standard errors, sigma, n) by Gauss-Newton with halved steps; b ends with the coefficients of the regressors X, whose errors follow the ARMA."""
    X = np.zeros((len(z), 0)) if X is None else X
    own = p + q + constant
    k = own + X.shape[1]
    b = np.zeros(k)
    if X.shape[1] and len(z):
        A = np.column_stack([X, np.ones(len(z))]) if constant else X
        b[own:] = np.linalg.lstsq(A, z, rcond=None)[0][: X.shape[1]]
    if constant:
        b[0] = (z - X @ b[own:]).mean() if len(z) else 0.0

    def errors(z, b, p, q, constant):
        return series_errors(z - X @ b[own:], b[:own], p, q, constant)

    n = len(z) - p
    if n <= k:
        return np.full(k, np.nan), np.full(k, np.nan), np.nan, n
    e = errors(z, b, p, q, constant)
    ssr = e @ e
    J = np.zeros((len(z), k))
    for _ in range(200):
        for j in range(k):
            h = 1e-6 * max(1.0, abs(b[j]))
            up = b.copy()
            up[j] += h
            J[:, j] = (errors(z, up, p, q, constant) - e) / h
        step = -np.linalg.solve(J.T @ J + 1e-8 * np.eye(k), J.T @ e)
        for _ in range(12):
            e2 = errors(z, b + step, p, q, constant)
            if np.isfinite(s2 := e2 @ e2) and s2 <= ssr:
                break
            step = step / 2
        else:
            break
        done = abs(ssr - s2) < 1e-12 * max(ssr, 1e-300)
        b, e, ssr = b + step, e2, s2
        if done:
            break
    sigma2 = ssr / n
    V = sigma2 * np.linalg.pinv(J.T @ J)
    return b, np.sqrt(np.maximum(np.diag(V), 0)), float(np.sqrt(sigma2)), n


def arima(df: DataFrame, series: str, time: str, value: str, order: tuple[int, int, int], constant: bool = True, regressors: dict[str, Column] | None = None) -> DataFrame:
    """One row per series and term: series, term, b, se, sigma, n. Rows that lack the value, the time or a regressor are left out, and neighbours are differenced whatever the time between them; regressors are differenced like the value."""
    p, d, q = order
    regressors = regressors or {}
    terms = [*(["_cons"] if constant else []), *[f"ar{i}" for i in range(1, p + 1)], *[f"ma{i}" for i in range(1, q + 1)], *regressors]
    names = [f"x{i}" for i in range(len(regressors))]
    x = df.select(F.col(series).alias("series"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), *[c.cast("double").alias(n) for n, c in zip(names, regressors.values(), strict=True)]).dropna(subset=["t", "v", *names])
    if not x.groupBy("series").count().filter(F.col("count") > MAX_LENGTH).isEmpty():
        raise DataError(198, f"a series has more than {MAX_LENGTH} rows; use long_series")
    kind = dict(x.dtypes)["series"]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        z = np.diff(g["v"].to_numpy(), n=d)
        b, se, sigma, n = fit(z, p, q, constant, np.diff(g[names].to_numpy(float), n=d, axis=0))
        return pd.DataFrame({"series": g["series"].iat[0], "term": terms, "b": b, "se": se, "sigma": sigma, "n": n})

    return x.groupBy("series").applyInPandas(one, f"series {kind}, term string, b double, se double, sigma double, n bigint")


def long_series(df: DataFrame, time: str, value: str, order: tuple[int, int, int], panel: str | None = None, long_lag: int = 12, regressors: dict[str, Column] | None = None) -> Estimates:
    """The two-stage regression, with regressors beside the lags; its windows are per panel, of which there should be many for a table this long."""
    p, d, q = order
    pan = Panel(time, panel)
    x = df.withColumn("z", pan.D(F.col(value).cast("double"), d))
    if q:
        lags = {f"z{i}": pan.L(F.col("z"), i) for i in range(1, long_lag + 1)}
        x = x.withColumns(lags)
        first = regress(x, "z", {k: F.col(k) for k in lags})
        res = F.col("z")
        for n, b in zip(first.names, first.b, strict=True):
            res = res - float(b) * (F.lit(1.0) if n == "_cons" else F.col(n))
        x = x.withColumn("e", res)
    cols = {**{f"ar{i}": pan.L(F.col("z"), i) for i in range(1, p + 1)}, **{f"ma{i}": pan.L(F.col("e"), i) for i in range(1, q + 1)}}
    for n, c in (regressors or {}).items():
        x = x.withColumn(f"__{n}", c.cast("double"))
        cols[n] = pan.D(F.col(f"__{n}"), d)
    x = x.withColumns(cols)
    return regress(x, "z", {k: F.col(k) for k in cols})


#: Distinct values of x up to which lowess gathers a group; beyond, they are joined into so many quantile bins.
LOWESS_POINTS = 20_000


def lowess(df: DataFrame, group: str, x: str, y: str, bandwidth: float = 0.8, mean: bool = False, adjust: bool = False) -> DataFrame:
    """(g, x, n, smooth): running line (or, with ``mean``, running mean) with tricube weights at each distinct x of a group.

    Rows of equal x are first put together (count and mean of y), which changes no smooth: the
    window of a point holds the nearest ``bandwidth`` share of the rows, ties in distance whole.
    A group with more than LOWESS_POINTS distinct x is put together in so many bins of equal
    numbers of rows, each at its mean x: an approximation whose error is that of moving a row
    within 1 / LOWESS_POINTS of the rows. ``adjust`` scales the smooth to the mean of y.
    """
    d = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    by_x = cut(d.groupBy("g", "x").agg(F.count("*").alias("n"), F.avg("y").alias("y")))
    long_ = by_x.groupBy("g").count().filter(F.col("count") > LOWESS_POINTS).select("g")
    if not long_.isEmpty():
        cuts = by_x.join(long_, "g").groupBy("g").agg(F.percentile_approx("x", F.array(*[F.lit(i / 1000) for i in range(1, 1000)]), F.lit(10_000)).alias("cuts"))
        binned = by_x.join(cuts, "g").withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
        edge = W.partitionBy("g", "b")
        inner = F.floor((F.col("x") - F.min("x").over(edge)) / (F.max("x").over(edge) - F.min("x").over(edge) + 1e-300) * (LOWESS_POINTS / 1000 - 1))
        binned = binned.withColumn("b2", inner).groupBy("g", "b", "b2").agg(F.sum("n").alias("m"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"))
        by_x = by_x.join(long_, "g", "left_anti").select("g", "x", "n", "y").unionByName(binned.select("g", "x", F.col("m").alias("n"), "y"))
    kind = dict(by_x.dtypes)["g"]

    def smooth(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("x")
        xs, ys, n = t["x"].to_numpy(), t["y"].to_numpy(), t["n"].to_numpy(float)
        need = min(n.sum(), max(2.0, np.floor(bandwidth * n.sum())))
        total = np.concatenate([[0.0], np.cumsum(n)])
        # the least distance at which the window of each point holds enough rows, all points bisected at once
        near, far = np.zeros(len(xs)), np.full(len(xs), xs[-1] - xs[0])
        for _ in range(60):
            mid = (near + far) / 2
            enough = total[np.searchsorted(xs, xs + mid, "right")] - total[np.searchsorted(xs, xs - mid, "left")] >= need
            near, far = np.where(enough, near, mid), np.where(enough, mid, far)
        first, last = np.searchsorted(xs, xs - far, "left"), np.searchsorted(xs, xs + far, "right")
        out = np.empty(len(xs))
        for i, (a, lo, hi) in enumerate(zip(xs, first, last, strict=True)):
            h = max(a - xs[lo], xs[hi - 1] - a) or 1.0
            u, v = xs[lo:hi], ys[lo:hi]
            w = n[lo:hi] * np.clip(1 - (np.abs(u - a) / h) ** 3, 0, None) ** 3
            sw = w.sum()
            if sw <= 0:
                out[i] = ys[i]
                continue
            mx, my = (w * u).sum() / sw, (w * v).sum() / sw
            vx = (w * (u - mx) ** 2).sum()
            out[i] = my if mean or vx <= 1e-12 * max(1.0, sw) else my + (w * (u - mx) * (v - my)).sum() / vx * (a - mx)
        if adjust and abs((n * out).sum()) > 1e-12:
            out *= (n * ys).sum() / (n * out).sum()
        return pd.DataFrame({"g": t["g"].iat[0], "x": xs, "n": n.astype(np.int64), "smooth": out})

    return by_x.groupBy("g").applyInPandas(smooth, f"g {kind}, x double, n bigint, smooth double")


def autocorrelation(df: DataFrame, panel: str, time: str, value: str, lags: int = 12) -> DataFrame:
    """Autocorrelations over all panels: lag, rho, n."""
    pan = Panel(time, panel)
    v = F.col(value).cast("double")
    x = df.select(v.alias("v"), *[pan.L(v, k).alias(f"l{k}") for k in range(1, lags + 1)])
    each = [F.struct(F.lit(k).alias("lag"), correlation(F.col("v"), F.col(f"l{k}")).alias("rho"), F.count_if(F.col("v").isNotNull() & F.col(f"l{k}").isNotNull()).alias("n")) for k in range(1, lags + 1)]
    return x.agg(F.array(*each).alias("a")).select(F.inline("a"))
