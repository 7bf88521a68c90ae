"""Queries of the estimators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import dates as D
from tabulon.models import arima as AR
from tabulon.models import design, glm, linear, post
from tabulon.operators import aggregate as A
from tabulon.session import code, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def coefficients(spark: SparkSession, *models: linear.Estimates, digits: int = 5) -> DataFrame:
    out = None
    for i, m in enumerate(models, 1):
        f = m.frame(spark).select(F.lit(i).alias("m"), "model", "term", F.round("b", digits).alias("b"), F.round("se", digits).alias("se"))
        out = f if out is None else out.unionByName(f)
    return out


def good(c: str):
    """A panel or grunfeld number, its missing guises being null."""
    return F.when((F.col(c) > 0) & (F.col(c) < 1e12), F.col(c))


def grunfeld(spark: SparkSession, d: str) -> DataFrame:
    """One row per firm and year, numbers cleaned: repeated rows keep the first that has all values."""
    g = table(spark, d, "grunfeld").select("row_id", F.col("firm").cast("long").alias("firm"), F.col("year").cast("int").alias("year"), *[good(c).alias(c) for c in ("invest", "value", "capital")])
    g = g.dropna(subset=["firm", "year", "invest", "value", "capital"])
    return A.duplicates_drop(g, ["firm", "year"], ["row_id"])


# NaN is excluded by its text: column statistics, which leave NaN out, may make the engine drop the range test
GRUNFELD = "(select * from (select row_id, cast(firm as bigint) as firm, cast(year as int) as year, invest, value, capital, row_number() over (partition by firm, year order by row_id) as rn from grunfeld where firm is not null and year is not null and invest > 0 and invest < 1e12 and value > 0 and value < 1e12 and capital > 0 and capital < 1e12 and cast(invest as varchar) <> 'nan' and cast(value as varchar) <> 'nan' and cast(capital as varchar) <> 'nan') where rn = 1)"


def _x(*names: str) -> dict:
    return {n: F.col(n) for n in names}


@query("""select 'l_quantity' as term, round(regr_slope(l_extendedprice, l_quantity), 5) as b, round(sqrt(((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2)) / regr_sxx(l_extendedprice, l_quantity)), 5) as se, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, count(*) as n from lineitem
union all select '_cons', round(regr_intercept(l_extendedprice, l_quantity), 5), round(sqrt(((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2)) * (1.0 / count(*) + power(avg(l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity))), 5), round(regr_r2(l_extendedprice, l_quantity), 6), count(*) from lineitem""")
def regress_ols(spark, d):
    e = linear.regress(table(spark, d, "lineitem"), "l_extendedprice", _x("l_quantity"))
    return e.frame(spark).select("term", F.round("b", 5).alias("b"), F.round("se", 5).alias("se"), F.lit(round(e.stats["r2"], 6)).alias("r2"), F.lit(e.n).cast("bigint").alias("n"))


@query("""with w as (select l_quantity as w, l_discount as x, l_tax as y from lineitem), s as (select sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from w),
c as (select sum(w * (x - mx) * (y - my)) as sxy, sum(w * (x - mx) * (x - mx)) as sxx, any_value(my) as my, any_value(mx) as mx from w, s)
select 'l_discount' as term, round(sxy / sxx, 8) as b from c union all select '_cons', round(my - sxy / sxx * mx, 8) from c""")
def regress_fweight(spark, d):
    e = linear.regress(table(spark, d, "lineitem"), "l_tax", _x("l_discount"), weight="l_quantity", kind="fweight")
    return e.frame(spark).select("term", F.round("b", 8).alias("b"))


@query("""with m as (select avg(l_quantity) as a, avg(l_discount) as b, avg(l_extendedprice) as y from lineitem),
s as (select sum((l_quantity - a) * (l_quantity - a)) as aa, sum((l_discount - b) * (l_discount - b)) as bb, sum((l_quantity - a) * (l_discount - b)) as ab, sum((l_quantity - a) * (l_extendedprice - y)) as ay, sum((l_discount - b) * (l_extendedprice - y)) as yb, any_value(a) as a, any_value(b) as b, any_value(y) as y from lineitem, m)
select 'l_quantity' as term, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 4) as b from s union all select 'l_discount', round((yb * aa - ay * ab) / (aa * bb - ab * ab), 4) from s
union all select '_cons', round(y - (ay * bb - yb * ab) / (aa * bb - ab * ab) * a - (yb * aa - ay * ab) / (aa * bb - ab * ab) * b, 4) from s""")
def regress_multi(spark, d):
    e = linear.regress(table(spark, d, "lineitem"), "l_extendedprice", _x("l_quantity", "l_discount"))
    return e.frame(spark).select("term", F.round("b", 4).alias("b"))


@query()
def regress_vce(spark, d):
    """The same model with classical, robust and clustered errors."""
    x = table(spark, d, "lineitem")
    t = _x("l_quantity", "l_discount")
    return coefficients(spark, linear.regress(x, "l_extendedprice", t), linear.regress(x, "l_extendedprice", t, robust=True), linear.regress(x, "l_extendedprice", t, cluster="l_suppkey"))


@query("select 'f' as term, l_linestatus, round(avg(l_extendedprice), 4) as mean from lineitem group by 2")
def regress_factor(spark, d):
    """A saturated factor model reproduces the group means."""
    x = table(spark, d, "lineitem").withColumn("g", F.when(F.col("l_linestatus") == "F", 0).otherwise(1))
    e = linear.regress(x, "l_extendedprice", design.expand(x, "i.g"))
    fit = post.predict(x, e, "mean").groupBy("l_linestatus").agg(F.round(F.max("mean"), 4).alias("mean"))
    return fit.select(F.lit("f").alias("term"), "l_linestatus", "mean")


@query(f"""with g as {GRUNFELD}, d as (select value - avg(value) over (partition by firm) as x, capital - avg(capital) over (partition by firm) as z, invest - avg(invest) over (partition by firm) as y from g),
s as (select sum(x * x) as xx, sum(z * z) as zz, sum(x * z) as xz, sum(x * y) as xy, sum(z * y) as zy from d)
select 'value' as term, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) as b from s union all select 'capital', round((zy * xx - xy * xz) / (xx * zz - xz * xz), 6) from s""")
def xtreg_fe(spark, d):
    e = linear.xtreg(grunfeld(spark, d), "invest", _x("value", "capital"), "firm")
    return e.frame(spark).select("term", F.round("b", 6).alias("b"))


@query()
def xtreg_all(spark, d):
    """Fixed, random and between effects and the clustered fixed effects."""
    g = grunfeld(spark, d)
    t = _x("value", "capital")
    return coefficients(spark, *[linear.xtreg(g, "invest", t, "firm", m) for m in ("fe", "re", "be")], linear.xtreg(g, "invest", t, "firm", "fe", robust=True))


@query()
def hausman_test(spark, d):
    g = grunfeld(spark, d)
    t = _x("value", "capital")
    h = linear.hausman(linear.xtreg(g, "invest", t, "firm"), linear.xtreg(g, "invest", t, "firm", "re"))
    n = g.agg(F.count("*").alias("n"))
    return n.select(F.lit(h["chi2"]).alias("chi2"), F.lit(h["df"]).alias("df"), F.lit(h["p"]).alias("p"), "n")


def _binary(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 100000).alias("price"), F.year("o_orderdate").cast("double").alias("yr"), "o_custkey")


@query()
def logit_probit(spark, d):
    x = _binary(spark, d)
    t = _x("price")
    return coefficients(spark, glm.glm(x, "y", t, "logit"), glm.glm(x, "y", t, "probit"), glm.glm(x, "y", t, "logit", robust=True), glm.glm(x, "y", t, "logit", cluster="o_custkey"))


@query()
def poisson_counts(spark, d):
    """Daily events of users on the day of the week."""
    from tabulon.plans.econ import user_days

    x = user_days(spark, d).withColumn("dow", D.dow("day"))
    e = glm.glm(x, "n", design.expand(x, "i.dow"), "poisson")
    return coefficients(spark, e)


@query()
def margins_effects(spark, d):
    x = _binary(spark, d)
    rows = []
    for f in ("logit", "probit"):
        e = glm.glm(x, "y", _x("price"), f)
        rows += [(f, at, r["term"], r["dydx"], r["se"]) for at in (False, True) for r in post.margins(x, e, atmeans=at)]
    return spark.createDataFrame(rows, "model string, atmeans boolean, term string, dydx double, se double")


@query()
def ivregress_2sls(spark, d):
    g = grunfeld(spark, d)
    e = linear.ivregress(g, "invest", _x("capital"), _x("value"), {"year": F.col("year").cast("double")})
    return coefficients(spark, e)


@query()
def predict_residuals(spark, d):
    """Fit, residual and standard error of the fit for every order."""
    x = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("double"))
    e = linear.regress(x, "o_totalprice", _x("yr"))
    x = post.predict(x, e, "fit", "xb")
    x = post.predict(post.predict(x, e, "res", "residuals"), e, "sdp", "stdp")
    return x.select("o_orderkey", F.round("fit", 4).alias("fit"), F.round("res", 4).alias("res"), F.round("sdp", 6).alias("sdp"))


@query()
def predict_panel(spark, d):
    """Firm effects and remaining errors after the fixed-effects model."""
    g = grunfeld(spark, d)
    e = linear.xtreg(g, "invest", _x("value", "capital"), "firm")
    return post.predict(post.predict(g, e, "u", "u"), e, "err", "e").select("row_id", F.round("u", 4).alias("u"), F.round("err", 4).alias("err"))


@query()
def tests_lincom(spark, d):
    x = table(spark, d, "lineitem")
    e = linear.regress(x, "l_extendedprice", _x("l_quantity", "l_discount"))
    t, j, c = post.test(e, "l_discount"), post.test(e, "l_quantity", "l_discount"), post.lincom(e, {"l_quantity": 10.0, "_cons": 1.0})
    n = x.agg(F.count("*").alias("n"))
    return n.select("n", *[F.lit(float(v)).alias(k) for k, v in (("F1", t["F"]), ("p1", t["p"]), ("F2", j["F"]), ("b", c["b"]), ("se", c["se"]))])


def carrier_months(spark, d):
    ok = (F.col("passengers") > 0) & ~F.isnan("passengers") & (F.col("month") == F.floor("month")) & F.col("month").between(1, 12)
    a = table(spark, d, "airline").filter(ok).select(code("carrier").alias("carrier"), D.ym(F.col("year"), F.col("month")).alias("t"), F.log("passengers").alias("lp"))
    return a.groupBy("carrier", "t").agg(F.avg("lp").alias("lp"))


@query()
def arima_carriers(spark, d):
    """ARIMA(1, 1, 1) of every carrier's log passengers."""
    return AR.arima(carrier_months(spark, d), "carrier", "t", "lp", (1, 1, 1))


@query()
def arima_long(spark, d):
    """The two-stage form over all carriers as one panel."""
    e = AR.long_series(carrier_months(spark, d), "t", "lp", (1, 1, 1), panel="carrier")
    return coefficients(spark, e)


@query()
def autocorrelations(spark, d):
    return AR.autocorrelation(carrier_months(spark, d), "carrier", "t", "lp")


@query()
def lowess_smooth(spark, d):
    return AR.lowess(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


# --- estimators against closed forms ---------------------------------------------------


def _rows(spark: SparkSession, rows: list[tuple], digits: int = 5) -> DataFrame:
    f = spark.createDataFrame([(m, t, float(b), None if s is None else float(s)) for m, t, b, s in rows], "model string, term string, b double, se double")
    return f.select("model", "term", F.round("b", digits).alias("b"), F.round("se", digits).alias("se"))


def _terms(model: str, e: linear.Estimates, *only: str) -> list[tuple]:
    return [(model, n, b, s) for n, b, s in zip(e.names, e.b, e.se, strict=True) if not only or n in only]


@query("""with m as (select avg(l_quantity) as mx, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, regr_sxx(l_extendedprice, l_quantity) as sxx, cast(count(*) as double) as n from lineitem),
r as (select l_suppkey, l_quantity - mx as x, l_extendedprice - a - b * l_quantity as e, b, sxx, n from lineitem, m),
g as (select l_suppkey, sum(x * e) as s, any_value(b) as b, any_value(sxx) as sxx, any_value(n) as n from r group by 1)
select 'robust' as model, 'l_quantity' as term, round(any_value(b), 5) as b, round(sqrt(any_value(n / (n - 2)) * sum(x * x * e * e)) / any_value(sxx), 5) as se from r
union all select 'cluster', 'l_quantity', round(any_value(b), 5), round(sqrt(count(*) / (count(*) - 1.0) * any_value((n - 1) / (n - 2)) * sum(s * s)) / any_value(sxx), 5) from g""")
def regress_robust(spark, d):
    """One regressor with robust and clustered errors."""
    x, t = table(spark, d, "lineitem"), _x("l_quantity")
    robust, cluster = linear.regress(x, "l_extendedprice", t, robust=True), linear.regress(x, "l_extendedprice", t, cluster="l_suppkey")
    return _rows(spark, _terms("robust", robust, "l_quantity") + _terms("cluster", cluster, "l_quantity"))


@query(f"""with g as {GRUNFELD}, f as (select firm, cast(count(*) as double) as t, avg(value) as mx, avg(invest) as my from g group by 1),
d as (select g.*, f.t, f.mx, f.my, value - mx as x, invest - my as y from g join f using (firm)),
w as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, cast(count(*) as double) as n, count(distinct firm) as k from d),
e as (select any_value(b) as b, any_value(sxx) as sxx, any_value(n) as n, any_value(k) as k, sum((y - b * x) * (y - b * x)) / any_value(n - k - 1) as s2e from d, w),
u as (select greatest(0, var_samp(my - b * mx) - any_value(s2e) / avg(t)) as s2u from f, e),
h as (select firm, 1 - sqrt(s2e / (t * s2u + s2e)) as th from f, e, u),
q as (select value - th * mx as x, invest - th * my as y, 1 - th as c from d join h using (firm)),
s as (select sum(x * x) as xx, sum(c * c) as cc, sum(x * c) as xc, sum(x * y) as xy, sum(c * y) as cy, sum(y * y) as yy, cast(count(*) as double) as n from q),
r as (select (xy * cc - cy * xc) / (xx * cc - xc * xc) as b, (cy * xx - xy * xc) / (xx * cc - xc * xc) as a, * from s),
v as (select *, (yy - b * xy - a * cy) / (n - 2) as s2 from r),
o as (select b as rb, a as ra, sqrt(s2 * cc / (xx * cc - xc * xc)) as rse, sqrt(s2 * xx / (xx * cc - xc * xc)) as rsa from v)
select 'fe' as model, 'value' as term, round(b, 5) as b, round(sqrt(s2e / sxx), 5) as se from e
union all select 'fe', 'sigma_u', round(sqrt(s2u), 3), null from u
union all select 'be', 'value', round(regr_slope(my, mx), 5), round(sqrt((1 - regr_r2(my, mx)) * regr_syy(my, mx) / (count(*) - 2) / regr_sxx(my, mx)), 5) from f
union all select 're', 'value', round(rb, 5), round(rse, 5) from o
union all select 're', '_cons', round(ra, 3), round(rsa, 3) from o
union all select 'hausman', 'chi2', round((b - rb) * (b - rb) / abs(s2e / sxx - rse * rse), 2), null from e, o""")
def xtreg_simple(spark, d):
    """Within, between and random effects of one regressor, and the test between them."""
    g, t = grunfeld(spark, d), _x("value")
    fe, be, re = (linear.xtreg(g, "invest", t, "firm", m) for m in ("fe", "be", "re"))
    cons = [(m, n, round(b, 3), round(s, 3)) for m, n, b, s in _terms("re", re, "_cons")]
    rows = _terms("fe", fe) + [("fe", "sigma_u", round(fe.stats["sigma_u"], 3), None)] + _terms("be", be, "value") + _terms("re", re, "value") + cons
    return _rows(spark, [*rows, ("hausman", "chi2", round(linear.hausman(fe, re)["chi2"], 2), None)])


_SHARES = "(select g, cast(count(*) as double) as n, avg(y) as p from (select case when o_totalprice > 100000 then 1 else 0 end as g, case when o_orderstatus = 'F' then 1.0 else 0.0 end as y from orders) group by 1)"


@query(f"""with s as {_SHARES}, a as (select * from s where g = 0), b as (select * from s where g = 1),
l as (select ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)) as b1, (a.n * a.p * (1 - a.p) + b.n * b.p * (1 - b.p)) / (a.n + b.n) as w from a, b)
select 'logit' as model, '1.g' as term, round(b1, 5) as b, round((select sqrt(1 / (a.n * a.p * (1 - a.p)) + 1 / (b.n * b.p * (1 - b.p))) from a, b), 5) as se from l
union all select 'logit', '_cons', round(ln(p / (1 - p)), 5), round(sqrt(1 / (n * p * (1 - p))), 5) from a
union all select 'logit', 'll', round(sum(n * (p * ln(p) + (1 - p) * ln(1 - p))), 2), null from s
union all select 'margins', '1.g', round(b1 * w, 5), null from l
union all select 'probit', 'p0', round(p, 5), null from a union all select 'probit', 'p1', round(p, 5), null from b""")
def logit_saturated(spark, d):
    """A factor of two levels, for which the maximum is known: log odds and their errors, the effect on the margin, and the shares that probit must return."""
    from tabulon.functions.numeric import phi

    o = table(spark, d, "orders")
    x = o.select((F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") > 100000).cast("int").alias("g"))
    t = design.expand(x, "i.g")
    e, p = glm.glm(x, "y", t, "logit"), glm.glm(x, "y", t, "probit")
    m = post.margins(x, e)[0]
    b = dict(zip(p.names, p.b, strict=True))
    rows = [*_terms("logit", e), ("logit", "ll", round(e.stats["ll"], 2), None), ("margins", "1.g", m["dydx"], None)]
    return _rows(spark, [*rows, ("probit", "p0", phi(b["_cons"]), None), ("probit", "p1", phi(b["_cons"] + b["1.g"]), None)])


@query("""with u as (select user_id, cast(ts as date) as dd, cast(count(value) as double) as n from events group by 1, 2), s as (select cast(dayofweek(dd) as int) as k, sum(n) as s, cast(count(*) as double) as c from u group by 1), a as (select * from s where k = 0)
select k || '.dow' as term, round(ln(s.s / s.c) - (select ln(s / c) from a), 5) as b, round(sqrt(1 / s.s + (select 1 / s from a)), 5) as se from s where k > 0 union all select '_cons', round(ln(s / c), 5), round(sqrt(1 / s), 5) from a""")
def poisson_saturated(spark, d):
    """Daily events of users on the day of the week, for which the maximum is known."""
    from tabulon.plans.econ import user_days

    x = user_days(spark, d).withColumn("dow", D.dow("day"))
    e = glm.glm(x, "n", design.expand(x, "i.dow"), "poisson")
    return _rows(spark, _terms("poisson", e)).drop("model")


@query(f"""with g as {GRUNFELD}, m as (select avg(value) as mv, avg(capital) as mc, avg(year) as mz, avg(invest) as my, cast(count(*) as double) as n from g),
d as (select value - mv as v, capital - mc as c, year - mz as z, invest - my as y from g, m),
s as (select sum(c * v) as cv, sum(c * c) as cc, sum(z * v) as zv, sum(z * c) as zc, sum(c * y) as cy, sum(z * y) as zy from d),
b as (select (zy * cc - cy * zc) / (zv * cc - cv * zc) as bv, (cy * zv - zy * cv) / (cc * zv - zc * cv) as bc from s)
select 'value' as term, round(bv, 4) as b from b union all select 'capital', round(bc, 4) from b union all select '_cons', round(my - bv * mv - bc * mc, 2) from b, m""")
def ivregress_exact(spark, d):
    """One instrument for one endogenous regressor: the coefficients in closed form."""
    e = linear.ivregress(grunfeld(spark, d), "invest", _x("capital"), _x("value"), {"year": F.col("year").cast("double")})
    return spark.createDataFrame([(n, round(float(b), 2 if n == "_cons" else 4)) for n, b in zip(e.names, e.b, strict=True)], "term string, b double")


_MONTHS = r"(select nullif(upper(regexp_replace(carrier, '^[ \t]+|[ \t]+$', '', 'g')), '') as carrier, cast((year - 1960) * 12 + month - 1 as double) as t, avg(ln(passengers)) as lp from airline where passengers > 0 and not isnan(passengers) and month = floor(month) and month between 1 and 12 group by 1, 2)"


@query(f"""with a as {_MONTHS}, z as (select carrier, t, lp - lag(lp) over (partition by carrier order by t) as z, row_number() over (partition by carrier order by t) as i from a where t is not null and carrier is not null),
l as (select carrier, z, lag(z) over (partition by carrier order by t) as z1, i from z where i > 1)
select carrier, count(*) as n, round(regr_slope(z, z1), 4) as b from l where z1 is not null group by 1 having count(*) > 20 and regr_sxx(z, z1) > 0.000001""")
def arima_ar1(spark, d):
    """ARIMA(1, 1, 0) of every carrier of more than 20 differences: conditional least squares is the regression on the lag."""
    x = carrier_months(spark, d).filter("carrier is not null and t is not null")
    a = AR.arima(x, "carrier", "t", "lp", (1, 1, 0)).filter("term = 'ar1' and n > 20")
    return a.select(F.col("series").alias("carrier"), "n", F.round("b", 4).alias("b")).filter("b is not null")


@query(f"with a as {_MONTHS} select k as lag, round(corr(x.lp, y.lp), 6) as rho, count(*) as n from range(1, 13) r(k) join a x on true join a y on y.carrier is not distinct from x.carrier and y.t = x.t - k group by 1")
def autocorrelations_checked(spark, d):
    return AR.autocorrelation(carrier_months(spark, d), "carrier", "t", "lp").withColumn("rho", F.round("rho", 6)).withColumn("lag", F.col("lag").cast("bigint"))


@query("""with b as (select l_returnflag as g, l_quantity as x, cast(count(*) as double) as n, avg(l_extendedprice) as y from lineitem group by 1, 2), t as (select g, floor(0.8 * sum(n)) as need from b group by 1),
p as (select a.g, a.x as a, c.x, c.n, c.y, abs(c.x - a.x) as dist, sum(c.n) over (partition by a.g, a.x order by abs(c.x - a.x)) as seen from b a join b c using (g)),
h as (select p.g, a, min(dist) as h from p join t using (g) where seen >= need group by 1, 2),
w as (select p.g, p.a, x, y, n * power(greatest(0, 1 - power(dist / h, 3)), 3) as w from p join h on h.g = p.g and h.a = p.a),
m as (select g, a, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from w group by 1, 2)
select w.g as g, w.a as x, round(any_value(my) + sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * (w.a - any_value(mx)), 3) as smooth from w join m on m.g = w.g and m.a = w.a group by 1, 2""")
def lowess_points(spark, d):
    """The smooth at every quantity."""
    return AR.lowess(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").select("g", "x", F.round("smooth", 3).alias("smooth"))


@query("select event_id, case when event_id % 7 <> 0 then 1.0 else 0.0 end as used from events")
def estimation_sample(spark, d):
    """The rows that a model of a variable with gaps used."""
    from tabulon.plans.econ import gappy

    x = gappy(spark, d)
    e = linear.regress(x, "value", _x("v"))
    return post.sample(x, e, "used").select("event_id", "used")


@query("""with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, avg(l_quantity) as mx, regr_sxx(l_extendedprice, l_quantity) as sxx, cast(count(*) as double) as n,
sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2)) as s from lineitem)
select round(10 * b + a, 4) as b, round(s * sqrt(1 / n + power(10 - mx, 2) / sxx), 4) as se, round(b * b * sxx / (s * s), 2) as f from m""")
def lincom_simple(spark, d):
    """A linear combination and its error, and the test of the slope."""
    e = linear.regress(table(spark, d, "lineitem"), "l_extendedprice", _x("l_quantity"))
    c, f = post.lincom(e, {"l_quantity": 10.0, "_cons": 1.0}), post.test(e, "l_quantity")["F"]
    return spark.createDataFrame([(round(c["b"], 4), round(c["se"], 4), round(float(f), 2))], "b double, se double, f double")


ORACLE["predict_residuals"] = """with m as (select regr_slope(o_totalprice, year(o_orderdate)) as b, regr_intercept(o_totalprice, year(o_orderdate)) as a, avg(year(o_orderdate)) as mx, regr_sxx(o_totalprice, year(o_orderdate)) as sxx, cast(count(*) as double) as n,
sqrt((1 - regr_r2(o_totalprice, year(o_orderdate))) * regr_syy(o_totalprice, year(o_orderdate)) / (count(*) - 2)) as s from orders)
select o_orderkey, round(a + b * year(o_orderdate), 4) as fit, round(o_totalprice - a - b * year(o_orderdate), 4) as res, round(s * sqrt(1 / n + power(year(o_orderdate) - mx, 2) / sxx), 6) as sdp from orders, m"""
ORACLE["predict_panel"] = f"""with g as {GRUNFELD}, d as (select value - avg(value) over (partition by firm) as x, capital - avg(capital) over (partition by firm) as z, invest - avg(invest) over (partition by firm) as y from g),
s as (select sum(x * x) as xx, sum(z * z) as zz, sum(x * z) as xz, sum(x * y) as xy, sum(z * y) as zy from d), b as (select (xy * zz - zy * xz) / (xx * zz - xz * xz) as bv, (zy * xx - xy * xz) / (xx * zz - xz * xz) as bc from s),
r as (select row_id, firm, invest - bv * value - bc * capital as r from g, b)
select row_id, round(avg(r) over (partition by firm) - avg(r) over (), 4) + 0.0 as u, round(r - avg(r) over (partition by firm), 4) + 0.0 as err from r"""
