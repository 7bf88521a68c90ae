"""Estimators on exact cases, identities and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.models import arima, design, glm, linear, post
from tabulon.report import tables


def x(*names):
    return {n: F.col(n) for n in names}


@pytest.fixture(scope="module")
def logit_data(spark):
    n = F.col("n")
    df = spark.range(1, 501).withColumnRenamed("id", "n")
    df = df.select(n, ((7 * n) % 100 * 0.02 - 1).alias("x1"), ((13 * n) % 50 * 0.04 - 1).alias("x2"), F.ceil(n / 20).alias("g"))
    return df.withColumn("y", (F.col("x1") + 0.5 * F.col("x2") + (17 * n) % 7 - 3 > 0).cast("double")).repartition(5)


def test_ols_equals_lstsq(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3))
    y = X @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=300)
    df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(X, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "y double, a double, b double, c double").repartition(6)
    e = linear.regress(df, "y", x("a", "b", "c"))
    A = np.column_stack([X, np.ones(300)])
    b = np.linalg.lstsq(A, y, rcond=None)[0]
    r = y - A @ b
    assert e.b == pytest.approx(b, rel=1e-10) and e.n == 300
    assert e.V == pytest.approx(r @ r / 296 * np.linalg.inv(A.T @ A), rel=1e-8)
    inv = np.linalg.inv(A.T @ A)
    assert linear.regress(df, "y", x("a", "b", "c"), robust=True).V == pytest.approx(inv @ (A.T * r**2) @ A @ inv * 300 / 296, rel=1e-8)
    twice = linear.regress(df.withColumn("d", 2 * F.col("a")), "y", x("a", "b", "d", "c"))
    assert twice.omitted == ["d"] and twice.names == ["a", "b", "c", "_cons"]


def test_weights(spark):
    rows = [(i, i + 0.5 + (i == 3), w) for i, w in zip(range(1, 6), (2, 3, 1, 2, 3), strict=True)]
    df = spark.createDataFrame([(float(a), float(b), w) for a, b, w in rows], "x double, y double, w int")
    rep = df.withColumn("k", F.explode(F.expr("sequence(1, w)")))
    a, b = linear.regress(df, "y", x("x"), weight="w", kind="fweight"), linear.regress(rep, "y", x("x"))
    assert a.n == 11 and a.b == pytest.approx(b.b) and a.V == pytest.approx(b.V)
    p, q = linear.regress(df, "y", x("x"), weight="w", kind="pweight"), linear.regress(df, "y", x("x"), weight="w", robust=True)
    assert p.V == pytest.approx(q.V)


def test_panel_exact(spark):
    df = spark.createDataFrame([(p, t, float(4 * p + t), 10.0 * (p + 1) + 4 * p + t) for p in range(3) for t in range(1, 5)], "p int, t int, x double, y double").repartition(4)
    fe = linear.xtreg(df, "y", x("x"), "p")
    assert fe.b[0] == pytest.approx(1) and fe.stats["r2_w"] == pytest.approx(1) and fe.stats["rho"] == pytest.approx(1) and fe.stats["sigma_u"] > 0
    be = linear.xtreg(spark.createDataFrame([((n + 3) // 4, float(n), 5 + 2.0 * n) for n in range(1, 13)], "c int, x double, y double"), "y", x("x"), "c", "be")
    assert dict(zip(be.names, be.b, strict=True)) == {"x": pytest.approx(2), "_cons": pytest.approx(5)}
    u = {r["p"]: r["u"] for r in post.predict(df, fe, "u", "u").select("p", "u").distinct().collect()}
    assert u[2] - u[0] == pytest.approx(20)


def test_random_effects_lie_between(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a := rng.normal()), 2 * a + u + rng.normal() * 0.5) for g in range(40) for u in [rng.normal() * 2] for _ in range(6)]
    df = spark.createDataFrame([(g, a, float(b)) for g, a, b in rows], "g int, x double, y double")
    fe, re = linear.xtreg(df, "y", x("x"), "g"), linear.xtreg(df, "y", x("x"), "g", "re")
    assert re.b[0] == pytest.approx(2, abs=0.15) and 0 < re.stats["theta"] < 1 and re.stats["sigma_u"] == pytest.approx(2, abs=0.6)
    h = linear.hausman(fe, re)
    assert h["df"] == 1 and 0 <= h["p"] <= 1


def test_factors(spark):
    df = spark.createDataFrame([((n + 3) // 4, float(n), 10.0 * ((n + 3) // 4) + n) for n in range(1, 13)], "country int, x double, y double")
    e = linear.regress(df, "y", design.expand(df, "x i.country"))
    assert dict(zip(e.names, e.b, strict=True)) == {"x": pytest.approx(1), "2.country": pytest.approx(10), "3.country": pytest.approx(20), "_cons": pytest.approx(10)}
    b2 = linear.regress(df, "y", design.expand(df, "x ib2.country"))
    assert dict(zip(b2.names, b2.b, strict=True))["1.country"] == pytest.approx(-10)
    s = df.withColumn("y", F.col("country") * 0.5 * F.col("x"))
    e = linear.regress(s, "y", design.expand(s, "c.x i.country#c.x"))
    assert dict(zip(e.names, e.b, strict=True))["3.country#c.x"] == pytest.approx(1)
    assert list(design.expand(df, "i.country##c.x")) == ["2.country", "3.country", "x", "2.country#c.x", "3.country#c.x"]


def test_logit_known_values(spark, logit_data):
    e = glm.glm(logit_data, "y", x("x1", "x2"), "logit", robust=True)
    assert e.b == pytest.approx([0.50361, 0.292661, -0.0056864], rel=1e-4) and e.stats["ll"] == pytest.approx(-339.486982, abs=1e-5)
    assert e.se == pytest.approx([0.159115, 0.157927, 0.0910172], rel=2e-3)
    c = glm.glm(logit_data, "y", x("x1", "x2"), "logit", cluster="g")
    assert c.se == pytest.approx([0.0938603, 0.112757, 0.053708], rel=2e-3)


def test_glm_closed_forms(spark):
    n = F.col("id")
    df = spark.range(1, 101).select((n % 2).cast("double").alias("y"))
    e = glm.glm(df, "y", {}, "logit")
    assert e.b[0] == pytest.approx(0, abs=1e-9) and e.se[0] == pytest.approx(0.2)
    assert glm.glm(df, "y", {}, "probit").se[0] == pytest.approx(np.sqrt(0.25 * 2 * np.pi) / 10)
    p = spark.range(1, 201).select((n % 5).cast("double").alias("y"))
    assert glm.glm(p, "y", {}, "poisson").b[0] == pytest.approx(np.log(2))
    flip = spark.range(1, 201).select(((n - 100.5) / 10).alias("x"), F.when((13 * n + 7) % 10 == 0, n <= 100).otherwise(n > 100).cast("double").alias("y"))
    assert glm.glm(flip, "y", x("x"), "logit").b[0] == pytest.approx(0.3780294752, rel=1e-6)
    assert glm.glm(flip, "y", x("x"), "probit").b[0] == pytest.approx(0.2047269948, rel=2e-5)


def test_margins_and_tests(spark, logit_data):
    n = F.col("id")
    df = spark.range(1, 101).select((n / 10).alias("x1"), ((7 * n) % 13 / 10).alias("x2"), n).withColumn("y", 2 + 3 * F.col("x1") - 1.5 * F.col("x2") + (11 * F.col("id")) % 7 - 3)
    e = linear.regress(df, "y", x("x1", "x2"))
    m = post.margins(df, e)
    assert [r["dydx"] for r in m] == pytest.approx([2.98212, -1.46885], rel=1e-5) and [r["se"] for r in m] == pytest.approx([0.0700675, 0.543869], rel=1e-5)
    assert post.test(e, "x1")["F"] == pytest.approx((e.b[0] / e.se[0]) ** 2) and post.lincom(e, {"x1": 1, "x2": -1})["b"] == pytest.approx(e.b[0] - e.b[1])
    lg = glm.glm(logit_data, "y", x("x1", "x2"), "logit")
    ame = post.margins(logit_data, lg)[0]["dydx"]
    p = logit_data.select(F.avg(1 / (1 + F.exp(-post.xb(lg)))).alias("p"), F.avg((1 / (1 + F.exp(-post.xb(lg)))) * (1 - 1 / (1 + F.exp(-post.xb(lg))))).alias("w")).first()
    assert ame == pytest.approx(p["w"] * lg.b[0]) and p["p"] == pytest.approx(logit_data.agg(F.avg("y")).first()[0])


def test_iv_equals_closed_form(spark):
    rng = np.random.default_rng(4)
    z, u = rng.normal(size=400), rng.normal(size=400)
    d = z + u + rng.normal(size=400)
    y = 2 * d + 3 * u
    df = spark.createDataFrame(np.column_stack([y, d, z]).tolist(), "y double, d double, z double")
    e = linear.ivregress(df, "y", {}, x("d"), x("z"))
    assert e.b[0] == pytest.approx(np.cov(z, y)[0, 1] / np.cov(z, d)[0, 1]) and e.stats["first_F"] > 10
    assert linear.ivregress(df, "y", {}, x("d"), x("z"), robust=True).se[0] > 0


def test_arima_recovers(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=4000)
    z = np.zeros(4000)
    for t in range(1, 4000):
        z[t] = 0.6 * z[t - 1] + e[t] + 0.3 * e[t - 1]
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(z)], "s string, t int, v double")
    got = {r["term"]: r["b"] for r in arima.arima(df, "s", "t", "v", (1, 0, 1)).collect()}
    assert got["ar1"] == pytest.approx(0.6, abs=0.06) and got["ma1"] == pytest.approx(0.3, abs=0.06)
    long = arima.long_series(df, "t", "v", (1, 0, 1), panel="s")
    assert dict(zip(long.names, long.b, strict=True))["ar1"] == pytest.approx(got["ar1"], abs=0.05)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i + i % 3) for i in range(30)], "x double, y double")
    e = linear.regress(df, "y", x("x"))
    led = tables.Ledger()
    led.store("m_1", e)
    text = led.table(form="latex")
    assert r"m\_1" in text and "tabular" in text and led.table(form="markdown").startswith("|") and "(0." in led.table()
    led.outreg(str(tmp_path / "t.txt"), e, "one")
    assert "\ttwo" in led.outreg(str(tmp_path / "t.txt"), e, "two") and e.frame(spark).count() == 2
    for svg in (tables.chart(df, "x", "y", "connected"), tables.combine([tables.chart(df, "x", "y")])):
        assert svg.startswith("<svg") and svg.endswith("</svg>")


def test_no_maximum_is_told(spark):
    import pytest
    from pyspark.sql import functions as F

    from tabulon.models import glm

    x = spark.createDataFrame([(float(i > 10), float(i)) for i in range(20)], "y double, x double")
    with pytest.warns(UserWarning, match="perfectly"):
        assert glm.glm(x, "y", {"x": F.col("x")}).stats["separated"]
    e = glm.glm(spark.createDataFrame([(float(i % 3 > 0), 1.0) for i in range(30)], "y double, x double"), "y", {"x": F.col("x")}, constant=False)
    assert e.names == ["x"] and abs(e.b[0] - 0.6931471805599453) < 1e-9


def test_regressors_of_a_series(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tabulon.models import arima as AR

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=400)
    e = np.zeros(400)
    for t in range(1, 400):
        e[t] = 0.5 * e[t - 1] + rnd.normal() * 0.1
    d = spark.createDataFrame([("a", float(t), float(2 + 3 * x[t] + e[t]), float(x[t])) for t in range(400)], "s string, t double, v double, x double")
    b = {r["term"]: r["b"] for r in AR.arima(d, "s", "t", "v", (1, 0, 0), regressors={"x": F.col("x")}).collect()}
    assert abs(b["x"] - 3) < 0.05 and abs(b["ar1"] - 0.5) < 0.15 and abs(b["_cons"] - 2) < 0.05


def test_smooth_at_every_point(spark):
    from tabulon.models import arima as AR

    line = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(30)] + [("a", 1e6, 2e6 + 1)], "g string, x double, y double")
    assert all(abs(r["smooth"] - (2 * r["x"] + 1)) < 1e-3 for r in AR.lowess(line, "g", "x", "y").collect())
    flat = AR.lowess(line.filter("x < 100"), "g", "x", "y", bandwidth=1.0, mean=True, adjust=True)
    assert abs(sum(r["smooth"] for r in flat.collect()) / 30 - 30.0) < 1e-9
