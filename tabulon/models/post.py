"""After estimation: predict, margins, tests, linear combinations, tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import chi2_cdf, f_tail, inv_t_tail, normal, normalden, t_tail
from tabulon.models.linear import Estimates
from tabulon.operators.prep import DataError


def xb(e: Estimates) -> Column:
    """The linear prediction as a Column; missing where a regressor is."""
    out = F.lit(0.0)
    for n, b in zip(e.names, e.b, strict=True):
        out = out + (F.lit(float(b)) if n == "_cons" else e.terms[n].cast("double") * float(b))
    return out


def predict(df: DataFrame, e: Estimates, name: str, what: str | None = None) -> DataFrame:
    """xb, residuals, stdp; pr after logit and probit, n after poisson (the defaults there); u, e, ue, xbu after xtreg."""
    default = {"logit": "pr", "probit": "pr", "poisson": "n"}.get(e.kind, "xb")
    what = what or default
    line = xb(e)
    if what == "xb":
        return df.withColumn(name, line)
    if what == "pr":
        return df.withColumn(name, 1 / (1 + F.exp(-line)) if e.kind == "logit" else normal(line))
    if what == "n":
        return df.withColumn(name, F.exp(line))
    if what == "residuals":
        return df.withColumn(name, F.col(e.depvar) - line)
    if what == "stdp":
        cols = [F.lit(1.0) if n == "_cons" else e.terms[n].cast("double") for n in e.names]
        v = F.lit(0.0)
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                v = v + a * b * float(e.V[i, j])
        return df.withColumn(name, F.sqrt(F.greatest(v, F.lit(0.0))))
    if what in ("u", "e", "ue", "xbu"):
        panel = e.extra["panel"]
        part = df.withColumn("__r", F.col(e.depvar) - line)
        mean = part.filter("__r is not null").groupBy(panel).agg(F.avg("__r").alias("__m")).withColumnRenamed(panel, "__p")
        part = part.join(mean, part[panel].eqNullSafe(F.col("__p")), "left")
        overall = part.agg(F.avg("__r")).first()[0] if e.kind == "xtreg, fe" else 0.0
        u = F.col("__m") - F.lit(overall)
        value = {"u": u, "e": F.col("__r") - F.col("__m"), "ue": F.col("__r") - F.lit(overall), "xbu": line + F.lit(overall) + u}[what]
        return part.withColumn(name, value).drop("__r", "__m", "__p")
    raise DataError(198, f"unknown prediction {what}")


def sample(df: DataFrame, e: Estimates, name: str) -> DataFrame:
    """1 in rows that the estimation could use, with the outcome and every regressor (the omitted ones too) present, else 0."""
    used = F.col(e.depvar).isNotNull() & ~F.isnan(F.col(e.depvar).cast("double"))
    for c in e.terms.values():
        used = used & c.isNotNull() & ~F.isnan(c.cast("double"))
    return df.withColumn(name, used.cast("double"))


def margins(df: DataFrame, e: Estimates, names: list[str] | None = None, atmeans: bool = False) -> list[dict]:
    """Average marginal effects (or those at the means) with delta-method errors, from one aggregate."""
    names = names or [n for n in e.names if n != "_cons" and n in e.terms]
    cols = [F.lit(1.0) if n == "_cons" else e.terms[n].cast("double") for n in e.names]
    ok = F.col(e.depvar).isNotNull()
    for c in cols:
        ok = ok & c.isNotNull()
    x = df.filter(ok)
    k = len(e.names)
    if e.kind not in ("logit", "probit", "poisson"):
        g, gx = 1.0, np.zeros(k)
    else:
        line = xb(e)
        if atmeans:
            mean = np.array(x.agg(*[F.avg(c) for c in cols]).first(), float)
            z = float(mean @ e.b)
            f, f1 = _slopes(e.kind, z)
            g, gx = f, f1 * mean
        else:
            p = 1 / (1 + F.exp(-line))
            f = {"logit": p * (1 - p), "probit": normalden(line), "poisson": F.exp(line)}[e.kind]
            f1 = {"logit": p * (1 - p) * (1 - 2 * p), "probit": -line * normalden(line), "poisson": F.exp(line)}[e.kind]
            r = x.agg(F.avg(f), *[F.avg(f1 * c) for c in cols]).first()
            g, gx = r[0], np.array(r[1:], float)
    out = []
    for n in names:
        j = e.names.index(n)
        grad = gx * e.b[j]
        grad[j] += g
        effect, se = g * e.b[j], math.sqrt(max(0.0, float(grad @ e.V @ grad)))
        out.append({"term": n, "dydx": float(effect), "se": se, "z": effect / se if se else math.nan})
    return out


def _slopes(kind: str, z: float) -> tuple[float, float]:
    if kind == "logit":
        p = 1 / (1 + math.exp(-z))
        return p * (1 - p), p * (1 - p) * (1 - 2 * p)
    if kind == "probit":
        d = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return d, -z * d
    return math.exp(z), math.exp(z)


def wald(e: Estimates, restrictions: list[tuple[dict[str, float], float]]) -> dict:
    """Joint test of linear restrictions, each (weights by name, value): F with residual degrees, chi-squared without."""
    Rm = np.array([[w.get(n, 0.0) for n in e.names] for w, _ in restrictions])
    d = Rm @ e.b - np.array([v for _, v in restrictions])
    stat = float(d @ np.linalg.pinv(Rm @ e.V @ Rm.T) @ d)
    q = len(restrictions)
    if math.isfinite(e.df_r):
        return {"F": stat / q, "df": q, "df_r": e.df_r, "p": float(f_tail(q, e.df_r, stat / q))}
    return {"chi2": stat, "df": q, "p": float(1 - chi2_cdf(q, stat))}


def test(e: Estimates, *names: str, value: float = 0.0) -> dict:
    return wald(e, [({n: 1.0}, value) for n in names])


def lincom(e: Estimates, weights: dict[str, float]) -> dict:
    w = np.array([weights.get(n, 0.0) for n in e.names])
    b, se = float(w @ e.b), math.sqrt(max(0.0, float(w @ e.V @ w)))
    t = b / se if se else math.nan
    q = float(inv_t_tail(e.df_r, 0.025)) if math.isfinite(e.df_r) else 1.959963984540054
    return {"b": b, "se": se, "t": t, "p": float(2 * t_tail(e.df_r, abs(t))) if math.isfinite(e.df_r) else math.erfc(abs(t) / math.sqrt(2)), "low": b - q * se, "high": b + q * se}
