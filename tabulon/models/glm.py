"""Logit, probit and Poisson by Newton-Raphson; every iteration is one distributed aggregate.

Partitions return their log likelihood, score and information as one array; the arrays are
added up by Spark, element by element, and the K x K step is taken on the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import chi2_cdf, ln_gamma, ln_phi
from tabulon.models.linear import Estimates, independent, prepared, sandwich, triangle
from tabulon.operators.prep import DataError


def parts(family: str, xb: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, its derivative in xb, minus its second derivative) per row."""
    if family == "logit":
        p = 1 / (1 + np.exp(-xb))
        return -np.logaddexp(0, np.where(y > 0, -xb, xb)), y - p, p * (1 - p)
    if family == "probit":
        s = np.where(y > 0, 1.0, -1.0)
        ll = ln_phi(s * xb)
        g = s * np.exp(-xb * xb / 2 - 0.5 * math.log(2 * math.pi) - ll)
        return ll, g, g * (g + xb)
    mu = np.exp(xb)
    return y * xb - mu - ln_gamma(y + 1), y - mu, mu


def sums(x: DataFrame, cols: list[str], b: np.ndarray, family: str) -> tuple[float, np.ndarray, np.ndarray]:
    k = len(cols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            A = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, k + 2))
            X, y, w = A[:, :k], A[:, k], A[:, k + 1]
            ll, g, h = parts(family, X @ b, y)
            total[0] += np.sum(w * ll)
            total[1 : k + 1] += X.T @ (w * g)
            total[k + 1 :] += (X.T @ (X * (w * h)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["a"])

    rows = x.select(*cols, "y", "w").mapInArrow(work, "a array<double>").select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(1 + k + k * k)
    for r in rows:
        v[r["i"]] = r["v"]
    return v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)


def glm(df: DataFrame, y: str, terms: dict[str, Column], family: str = "logit", weight: str | None = None, robust: bool = False, cluster: str | None = None, constant: bool = True) -> Estimates:
    """Maximum likelihood; frequency weights multiply a row's likelihood.

    Where the regressors tell the outcomes of logit or probit apart without error there is no
    maximum: the likelihood comes near 1, the coefficients mean nothing, and a warning is given
    and ``stats["separated"]`` set.
    """
    if family not in ("logit", "probit", "poisson"):
        raise DataError(198, f"unknown family {family}")
    x = prepared(df, F.col(y), terms, F.col(weight) if weight else None, {"cl": F.col(cluster)} if cluster else {})
    outcome = F.col("y") if family == "poisson" else (F.col("y") != 0).cast("double")
    x = x.withColumn("y", outcome).withColumn("one", F.lit(1.0)).persist(StorageLevel.DISK_ONLY)
    try:
        names = [*terms, *(["_cons"] if constant else [])]
        raw = [*[f"x{i}" for i in range(len(terms))], *(["one"] if constant else [])]
        R = triangle(x, [*raw, "y"])
        order = [len(raw) - 1, *range(len(raw) - 1)] if constant else list(range(len(raw)))
        kept = sorted(order[i] for i in independent(R[:, order]))
        use = [raw[j] for j in kept]
        m = x.agg(F.avg("y"), F.count("*"), F.sum("w")).first()
        if m[0] is None or (family != "poisson" and not 0 < m[0] < 1) or (family == "poisson" and m[0] <= 0):
            raise DataError(2000, "outcome does not vary")
        b = np.zeros(len(use))
        p0 = m[0]
        if constant:
            b[-1] = math.log(p0) if family == "poisson" else math.log(p0 / (1 - p0)) * (1.0 if family == "logit" else 0.6)
        null, _, _ = sums(x, ["one"], np.array([_null(family, p0) if constant else 0.0]), family)
        ll, g, H = sums(x, use, b, family)
        for it in range(50):
            step = np.linalg.solve(H, g)
            for _ in range(8):  # halve a step that does not improve
                ll2, g2, H2 = sums(x, use, b + step, family)
                if ll2 >= ll - 1e-12 * abs(ll):
                    break
                step = step / 2
            if family != "poisson" and ll2 > -1e-6 * m[2]:  # predicted perfectly: further steps only grow
                b, ll, g, H = b + step, ll2, g2, H2
                break
            b, change = b + step, abs(ll2 - ll)
            ll, g, H = ll2, g2, H2
            if change < 1e-12 * max(1.0, abs(ll)):
                break
        V = np.linalg.inv(H)
        n = int(round(m[2])) if weight else m[1]
        if robust or cluster:
            xb = F.lit(0.0)
            for c, v in zip(use, b, strict=True):
                xb = xb + float(v) * F.col(c)
            fit = {"logit": 1 / (1 + F.exp(-xb)), "poisson": F.exp(xb)}.get(family)
            if fit is None:
                scored = _probit_score(x, use, b, ["cl"] if cluster else [])
                meat, gr = sandwich(scored, use, F.col("score"), "cl" if cluster else None)
            else:
                meat, gr = sandwich(x, use, F.col("w") * (F.col("y") - fit), "cl" if cluster else None)
            k = len(use)
            V = V @ meat @ V * (gr / (gr - 1) * (n - 1) / (n - k) if cluster else n / (n - k))
        chi = 2 * (ll - null)
        k = len(use) - constant
        separated = family != "poisson" and ll > -1e-6 * m[2]
        if separated:
            warnings.warn("the outcome is predicted perfectly; the coefficients are not identified", stacklevel=2)
        stats = {"separated": separated, "N": n, "ll": ll, "ll_0": null, "chi2": chi, "p": float(1 - chi2_cdf(k, chi)) if k else math.nan, "r2_p": 1 - ll / null if null else math.nan, "iterations": it + 1}
        return Estimates(family, y, [names[j] for j in kept], b, V, n, math.inf, [v for j, v in enumerate(names) if j not in kept], stats, dict(terms))
    finally:
        x.unpersist()


def _null(family: str, p: float) -> float:
    from tabulon.functions.numeric import inv_phi

    return {"logit": lambda: math.log(p / (1 - p)), "probit": lambda: float(inv_phi(p)), "poisson": lambda: math.log(p)}[family]()


def _probit_score(x: DataFrame, cols: list[str], b: np.ndarray, keep: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            A = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols) + 2)]) if batch.num_rows else np.zeros((0, len(cols) + 2))
            _, g, _ = parts("probit", A[:, : len(cols)] @ b, A[:, len(cols)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g * A[:, len(cols) + 1])], [*batch.schema.names, "score"])

    d = x.select(*cols, "y", "w", *keep)
    return d.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", score double")
