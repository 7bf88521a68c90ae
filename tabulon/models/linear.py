"""Least squares on distributed rows: OLS and WLS by TSQR, panel estimators, two-stage least squares.

Each partition reduces its rows to one small triangular factor of [X y]; factors are combined
in a tree of at most a few hundred per step, and the K x K algebra is done on the driver, as
accurate as a QR of the whole. Residuals are never collected: robust and clustered variances
come from one more aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import chi2_cdf, f_tail, inv_t_tail, t_tail
from tabulon.operators.aggregate import correlation
from tabulon.operators.prep import DataError


@dataclass
class Estimates:
    """A fitted model: coefficients in the order of ``names``, their variance and the fit."""

    kind: str
    depvar: str
    names: list[str]
    b: np.ndarray
    V: np.ndarray
    n: int
    df_r: float = math.inf
    omitted: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    terms: dict[str, Column] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.V), 0))

    def table(self) -> list[dict]:
        out = []
        for n, b, s in zip(self.names, self.b, self.se, strict=True):
            t = b / s if s > 0 else math.nan
            p = math.nan if t != t else 2 * t_tail(self.df_r, abs(t)) if math.isfinite(self.df_r) else math.erfc(abs(t) / math.sqrt(2))
            q = inv_t_tail(self.df_r, 0.025) if math.isfinite(self.df_r) else 1.959963984540054
            out.append({"term": n, "b": float(b), "se": float(s), "t": float(t), "p": float(p), "low": float(b - q * s), "high": float(b + q * s)})
        return out

    def frame(self, spark) -> DataFrame:
        rows = [(self.kind, self.depvar, *(r[k] for k in ("term", "b", "se", "t", "p"))) for r in self.table()]
        return spark.createDataFrame(rows, "model string, depvar string, term string, b double, se double, t double, p double")


def prepared(df: DataFrame, y: Column, terms: dict[str, Column], weight: Column | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Complete rows as y, x0..xk-1, w and the kept columns."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    x = df.select(y.cast("double").alias("y"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())], w.alias("w"), *[c.alias(n) for n, c in (keep or {}).items()])
    num = ["y", *[f"x{i}" for i in range(len(terms))], "w"]
    ok = F.lit(True)
    for c in num:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    for c in keep or {}:
        ok = ok & F.col(c).isNotNull()
    return x.filter(ok & (F.col("w") > 0))


def triangle(df: DataFrame, columns: list[str], fan_in: int = 200) -> np.ndarray:
    """R of the QR of the columns over all rows (TSQR)."""
    k = len(columns)
    schema = "part int, r array<double>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R = np.zeros((0, k))
        for b in batches:
            A = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, k))
            R = np.linalg.qr(np.vstack([R, A]), mode="r")
        if len(R):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([R.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R = np.zeros((0, k))
        for b in batches:
            for r in b.column(1).to_pylist():
                R = np.linalg.qr(np.vstack([R, np.array(r).reshape(-1, k)]), mode="r")
        if len(R):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([R.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])

    parts = df.select(*columns).mapInArrow(reduce, schema)
    n = df.rdd.getNumPartitions()
    while n > fan_in:  # a tree, so that the driver never stacks more than fan_in factors
        n = max(1, n // fan_in)
        parts = parts.repartition(n).mapInArrow(combine, schema)
    R = np.zeros((0, k))
    for row in parts.collect():
        R = np.linalg.qr(np.vstack([R, np.array(row["r"]).reshape(-1, k)]), mode="r")
    full = np.zeros((k, k))
    full[: len(R)] = R
    return full


def independent(R: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns of R that are not combinations of earlier ones."""
    keep: list[int] = []
    for j in range(R.shape[1]):
        v = R[:, j]
        if keep:
            Q, _ = np.linalg.qr(R[:, keep])
            v = v - Q @ (Q.T @ v)
        if np.linalg.norm(v) > tol * max(np.linalg.norm(R[:, j]), 1e-300):
            keep.append(j)
    return keep


def sandwich(x: DataFrame, cols: list[str], score: Column, cluster: str | None = None) -> tuple[np.ndarray, int]:
    """Sum of outer products of the scores score * x, per row or per cluster; (matrix, clusters)."""
    s = [(score * (F.col(c) if c != "1" else F.lit(1.0))).alias(f"s{i}") for i, c in enumerate(cols)]
    if cluster is None:
        z = x.select(*s)
        g = 0
    else:
        z = x.groupBy(cluster).agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate(s)])
        g = 1
    k = len(cols)
    prods = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i + 1)]
    r = z.agg(F.count("*"), *prods).first()
    M = np.zeros((k, k))
    it = iter(r[1:])
    for i in range(k):
        for j in range(i + 1):
            M[i, j] = M[j, i] = next(it) or 0.0
    return M, r[0] if g else 0


def regress(df: DataFrame, y: str, terms: dict[str, Column], weight: str | None = None, kind: str = "aweight", robust: bool = False, cluster: str | None = None, constant: bool = True) -> Estimates:
    """OLS or WLS. fweight: w copies of a row; aweight: scaled to n; pweight: as aweight, robust; iweight: taken as they are, N their whole sum, classical errors only."""
    if kind not in ("fweight", "aweight", "pweight", "iweight"):
        raise DataError(198, f"unknown weight {kind}")
    if kind == "iweight" and weight and (robust or cluster):
        raise DataError(101, "iweights have no robust errors")
    keep = {"cl": F.col(cluster)} if cluster else {}
    x = prepared(df, F.col(y), terms, F.col(weight) if weight else None, keep)
    n, sw = x.agg(F.count("*"), F.sum("w")).first()
    robust = robust or kind == "pweight" and weight is not None
    N = int(sw) if kind == "iweight" and weight else int(round(sw)) if kind == "fweight" and weight else n
    scale = 1.0 if kind in ("fweight", "iweight") or not weight or not n else n / sw
    names = [*terms, *(["_cons"] if constant else [])]
    raw = [*[f"x{i}" for i in range(len(terms))], *(["1"] if constant else [])]
    root = F.sqrt(F.col("w") * scale)
    cols = [(root * (F.col(c) if c != "1" else F.lit(1.0))).alias(f"a{i}") for i, c in enumerate(raw)]
    R = triangle(x.select(*cols, (root * F.col("y")).alias("b")), [*[f"a{i}" for i in range(len(raw))], "b"])
    order = [len(raw) - 1, *range(len(raw) - 1)] if constant else list(range(len(raw)))
    kept = sorted(order[i] for i in independent(R[:, order]))
    K = len(kept)
    if N <= K:
        raise DataError(2001, "insufficient observations")
    Q, Rk = np.linalg.qr(R[:, kept])
    b = np.linalg.solve(Rk, Q.T @ R[:, -1])
    rss = float(np.sum((R[:, -1] - R[:, kept] @ b) ** 2))
    inv = np.linalg.inv(Rk)
    XXi = inv @ inv.T
    # the total sum of squares is in the triangle too: what the constant leaves of the outcome
    ry = R[:, -1]
    if constant:
        one = R[:, len(raw) - 1]
        ry = ry - one * (one @ ry) / (one @ one)
    tss = float(ry @ ry)
    if rss < 1e-12 * tss:
        rss = 0.0
    df_r = N - K
    s2 = rss / df_r
    V = s2 * XXi
    fit = F.lit(0.0)
    for j, c in zip(kept, b, strict=True):
        fit = fit + float(c) * (F.col(raw[j]) if raw[j] != "1" else F.lit(1.0))
    use = [raw[j] for j in kept]
    resid = F.col("y") - fit
    if cluster:
        meat, g = sandwich(x, use, F.col("w") * scale * resid, "cl")
        V = XXi @ meat @ XXi * (g / (g - 1) * (n - 1) / (n - K))
        df_r = g - 1
    elif robust:
        meat, _ = sandwich(x, use, F.col("w") * scale * resid if kind != "fweight" else F.sqrt("w") * resid)
        V = XXi @ meat @ XXi * (N / (N - K))
    slopes = [i for i, j in enumerate(kept) if raw[j] != "1"]
    F_stat = float(b[slopes] @ np.linalg.pinv(V[np.ix_(slopes, slopes)]) @ b[slopes] / len(slopes)) if slopes and rss > 0 else math.nan
    r2 = 1 - rss / tss if tss > 0 else math.nan
    stats = {"N": N, "r2": r2, "r2_a": 1 - (1 - r2) * (N - (1 if constant else 0)) / (N - K), "rmse": math.sqrt(s2), "rss": rss, "tss": tss, "F": F_stat, "df_m": len(slopes), "p": float(f_tail(len(slopes), df_r, F_stat)) if F_stat == F_stat else math.nan}
    kept_names = [names[j] for j in kept]
    return Estimates("regress", y, kept_names, b, V, N, df_r, [v for j, v in enumerate(names) if j not in kept], stats, dict(terms))


def _panel_frame(df: DataFrame, y: str, terms: dict[str, Column], panel: str, cluster: str | None = None) -> tuple[DataFrame, list[str]]:
    keep = {"g": F.col(panel)} | ({"cl": F.col(cluster)} if cluster else {})
    x = prepared(df, F.col(y), terms, None, keep)
    return x, ["y", *[f"x{i}" for i in range(len(terms))]]


def _from_rows(x: DataFrame, cols: list[str]) -> tuple[np.ndarray, float, np.ndarray, list[int]]:
    """(b, rss, (X'X)^-1, kept) of the last column on the others."""
    R = triangle(x, cols)
    kept = independent(R[:, :-1])
    Q, Rk = np.linalg.qr(R[:, kept])
    b = np.linalg.solve(Rk, Q.T @ R[:, -1])
    inv = np.linalg.inv(Rk)
    return b, float(np.sum((R[:, -1] - R[:, kept] @ b) ** 2)), inv @ inv.T, kept


def xtreg(df: DataFrame, y: str, terms: dict[str, Column], panel: str, model: str = "fe", robust: bool = False, cluster: str | None = None) -> Estimates:
    """Panel regression: ``fe`` within, ``re`` random effects, ``be`` between.

    sigma_u is that of the fixed effects less the noise of their means, sigma_e / sqrt(T), and
    weighs the random effects too (Swamy and Arora would take it from the between regression).

    Panel means are one group-by; they are joined back on the panel key, so a panel with a
    third of all rows is split by adaptive execution and never gathered in one task.
    """
    if robust and cluster is None:
        cluster = panel
    x, cols = _panel_frame(df, y, terms, panel, cluster)
    xs = cols[1:]
    means = x.groupBy("g").agg(F.count("*").alias("T"), *[F.avg(c).alias(f"m_{c}") for c in cols])
    grand = x.agg(F.count("*"), *[F.avg(c) for c in cols]).first()
    N, gm = grand[0], dict(zip(cols, grand[1:], strict=True))
    G, Tbar = means.agg(F.count("*"), F.avg("T")).first()
    within = x.join(means, "g")
    # between estimator, needed by be and re
    bx = means.select(*[F.col(f"m_{c}").alias(c) for c in xs], F.lit(1.0).alias("one"), F.col("m_y").alias("y"))
    if model == "be":
        b, rss, XXi, kept = _from_rows(bx, [*xs, "one", "y"])
        names = [*terms, "_cons"]
        K = len(kept)
        tss = bx.agg(F.var_samp("y") * (F.count("*") - 1)).first()[0]
        V = rss / (G - K) * XXi
        return Estimates("xtreg, be", y, [names[j] for j in kept], b, V, N, G - K, [n for j, n in enumerate(names) if j not in kept], {"N": N, "N_g": G, "r2_b": 1 - rss / tss, "rmse": math.sqrt(rss / (G - K))}, dict(terms), {"panel": panel})
    dm = within.select(*[(F.col(c) - F.col(f"m_{c}") + gm[c]).alias(c) for c in cols], F.lit(1.0).alias("one"), *[c for c in ("g", "cl") if c in x.columns])
    bw, rss, XXi, kept = _from_rows(dm, [*xs, "one", "y"])
    names = [*terms, "_cons"]
    slopes = [j for j in kept if j < len(xs)]
    pos = [kept.index(j) for j in slopes]
    K = len(slopes)
    df_r = N - G - K
    tss_w = dm.agg(F.var_samp("y") * (F.count("*") - 1)).first()[0]
    if rss < 1e-12 * tss_w:
        rss = 0.0
    s2e = rss / df_r
    b = bw[pos]
    V = s2e * XXi[np.ix_(pos, pos)]
    fitted = lambda pre: sum((float(v) * F.col(f"{pre}{xs[j]}") for v, j in zip(b, slopes, strict=True)), F.lit(0.0))
    per = means.select((F.col("m_y") - fitted("m_")).alias("a"), fitted("m_").alias("fit"), "m_y")
    a = per.agg(F.var_samp("a"), correlation(F.col("fit"), F.col("m_y"))).first()
    all_r2 = x.agg(correlation(fitted(""), F.col("y"))).first()[0]
    # the fixed effects hold the noise of their means, s2e / T, which is taken off
    s2u = max(0.0, (a[0] or 0.0) - s2e / Tbar)
    stats = {"N": N, "N_g": G, "r2_w": 1 - rss / tss_w, "r2_b": (a[1] or 0.0) ** 2, "r2_o": (all_r2 or 0.0) ** 2, "sigma_e": math.sqrt(s2e), "sigma_u": math.sqrt(s2u)}
    if model == "fe":
        if cluster:
            resid = F.col("y") - sum((float(v) * F.col(xs[j] if j < len(xs) else "one") for v, j in zip(bw, kept, strict=True)), F.lit(0.0))
            # scores of the demeaned regressors
            dm2 = dm.withColumn("e", resid).withColumns({xs[j]: F.col(xs[j]) - gm[xs[j]] for j in slopes})
            meat, g = sandwich(dm2, [xs[j] for j in slopes], F.col("e"), "cl")
            B = XXi[np.ix_(pos, pos)]
            V = B @ meat @ B * (g / (g - 1) * (N - 1) / (N - K - 1))
            df_r = g - 1
        su = stats["sigma_u"]
        stats["rho"] = su**2 / (su**2 + s2e) if su**2 + s2e > 0 else math.nan
        pooled = x.select(*xs, F.lit(1.0).alias("one"), "y")
        _, rss_p, _, _ = _from_rows(pooled, [*xs, "one", "y"])
        stats["F_f"] = ((rss_p - rss) / (G - 1)) / s2e if s2e > 0 and G > 1 else math.nan
        return Estimates("xtreg, fe", y, [names[j] for j in slopes], b, V, N, df_r, [n for j, n in enumerate(terms) if j not in slopes], stats, dict(terms), {"panel": panel})
    theta = 1 - F.sqrt(F.lit(s2e) / (F.col("T") * s2u + s2e)) if s2e + s2u > 0 else F.lit(1.0)
    if s2e == 0 and s2u > 0:
        theta = F.lit(1.0)
    q = within.withColumn("th", theta).select(*[(F.col(c) - F.col("th") * F.col(f"m_{c}")).alias(c) for c in cols], (1 - F.col("th")).alias("one"), *[c for c in ("cl",) if c in x.columns])
    b, rss_q, XXi, kept = _from_rows(q, [*xs, "one", "y"])
    K = len(kept)
    V = rss_q / (N - K) * XXi
    if cluster:
        resid = F.col("y") - sum((float(v) * F.col(xs[j] if j < len(xs) else "one") for v, j in zip(b, kept, strict=True)), F.lit(0.0))
        meat, g = sandwich(q.withColumn("e", resid), [xs[j] if j < len(xs) else "one" for j in kept], F.col("e"), "cl")
        V = XXi @ meat @ XXi * (g / (g - 1) * (N - 1) / (N - K))
    stats |= {"sigma_u": math.sqrt(s2u), "rho": s2u / (s2u + s2e) if s2u + s2e > 0 else math.nan, "theta": 1 - math.sqrt(s2e / (Tbar * s2u + s2e)) if s2e + s2u > 0 else math.nan}
    return Estimates("xtreg, re", y, [names[j] for j in kept], b, V, N, math.inf, [n for j, n in enumerate(names) if j not in kept], stats, dict(terms), {"panel": panel})


def hausman(fe: Estimates, re: Estimates) -> dict:
    """Test of the random against the fixed effects on their common slopes."""
    common = [n for n in fe.names if n in re.names and n != "_cons"]
    i, j = [fe.names.index(n) for n in common], [re.names.index(n) for n in common]
    d = fe.b[i] - re.b[j]
    D = fe.V[np.ix_(i, i)] - re.V[np.ix_(j, j)]
    definite = bool(np.all(np.linalg.eigvalsh(D) > 0)) if len(common) else False
    chi = abs(float(d @ (np.linalg.inv(D) if definite else np.linalg.pinv(D)) @ d))
    return {"chi2": chi, "df": len(common), "p": float(1 - chi2_cdf(len(common), chi)), "positive_definite": definite}


def ivregress(df: DataFrame, y: str, exog: dict[str, Column], endog: dict[str, Column], instruments: dict[str, Column], robust: bool = False) -> Estimates:
    """Two-stage least squares from one TSQR of [Z X y]; rows with any missing part are left out."""
    if len(instruments) < len(endog):
        raise DataError(481, "fewer instruments than endogenous regressors")
    every = {**{f"e_{k}": v for k, v in exog.items()}, **{f"n_{k}": v for k, v in endog.items()}, **{f"i_{k}": v for k, v in instruments.items()}}
    x = prepared(df, F.col(y), every)
    e, p, q = len(exog), len(endog), len(instruments)
    ex, en, ins = [f"x{i}" for i in range(e)], [f"x{i}" for i in range(e, e + p)], [f"x{i}" for i in range(e + p, e + p + q)]
    x = x.withColumn("one", F.lit(1.0))
    Z, X = [*ex, "one", *ins], [*en, *ex, "one"]
    cols = [*Z, *en, "y"]
    R = triangle(x, cols)
    n = x.count()
    at = {c: i for i, c in enumerate(cols)}
    Rz, Rx, ry = R[:, [at[c] for c in Z]], R[:, [at[c] for c in X]], R[:, at["y"]]
    Qz, _ = np.linalg.qr(Rz[:, independent(Rz)])
    Xh = Qz @ (Qz.T @ Rx)
    kept = independent(Xh)
    A = np.linalg.inv(Xh[:, kept].T @ Xh[:, kept])
    b = A @ Xh[:, kept].T @ ry
    rss = float(np.sum((ry - Rx[:, kept] @ b) ** 2))
    V = rss / n * A
    names = [*endog, *exog, "_cons"]
    if robust:
        P = np.linalg.pinv(Rz) @ Rx  # first stage
        fit = {c: sum((float(P[k, m]) * F.col(z) for k, z in enumerate(Z)), F.lit(0.0)) for m, c in enumerate(X)}
        resid = F.col("y") - sum((float(v) * F.col(X[j]) for v, j in zip(b, kept, strict=True)), F.lit(0.0))
        h = x.select(*[fit[X[j]].alias(f"h{k}") for k, j in enumerate(kept)], resid.alias("e"))
        meat, _ = sandwich(h, [f"h{k}" for k in range(len(kept))], F.col("e"))
        V = A @ meat @ A
    first = []
    Qe, _ = np.linalg.qr(R[:, [at[c] for c in [*ex, "one"]]])
    for c in en:
        r = R[:, at[c]]
        full = float(np.sum((r - Qz @ (Qz.T @ r)) ** 2))
        short = float(np.sum((r - Qe @ (Qe.T @ r)) ** 2))
        first.append(((short - full) / q) / (full / (n - Qz.shape[1])) if full > 0 else math.inf)
    return Estimates("ivregress 2sls", y, [names[j] for j in kept], b, V, n, math.inf, [v for j, v in enumerate(names) if j not in kept], {"N": n, "rmse": math.sqrt(rss / n), "first_F": min(first)}, {**endog, **exog})


def f_p(d1: float, d2: float, f: float) -> float:
    return float(f_tail(d1, d2, f))
