"""Preparation, windows, joins, reshaping and summaries on small frames."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregate as A
from tabulon.operators import merge as MG
from tabulon.operators import prep as P
from tabulon.operators import reshape as R
from tabulon.operators import window as WN


def vals(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_varlists_and_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, gdp_a int, gdp_b int, x int")
    assert P.varlist(df, "gdp_*") == ["gdp_a", "gdp_b"] and P.varlist(df, "gdp_a-x") == ["gdp_a", "gdp_b", "x"] and P.varlist(df, "i") == ["id"]
    with pytest.raises(P.DataError):
        P.varlist(df, "g")
    assert P.rename(df, "gdp_* x", "y*_n z").columns == ["id", "ya_n", "yb_n", "z"]
    assert P.rename(df, "id x", "x id").columns == ["x", "gdp_a", "gdp_b", "id"]
    assert P.order(df, "x gdp_b").columns == ["x", "gdp_b", "id", "gdp_a"] and P.aorder(df).columns == ["gdp_a", "gdp_b", "id", "x"]
    with pytest.raises(P.DataError):
        P.generate(df, "x", F.lit(1))


def test_recode_encode_destring(spark):
    df = spark.createDataFrame([(1, 1.0, "b", "$1,000"), (2, None, "a", "."), (3, 9.0, "", "2")], "id int, x double, s string, t string")
    r = P.recode(df, ["x"], [("missing", 0), ((None, 5), 1), ("else", 7)], ["y"])
    assert vals(r.select("id", "y"), "id") == [(1, 1.0), (2, 0.0), (3, 7.0)]
    e, values = P.encode(df, "s", "n")
    assert values == {1: "a", 2: "b"} and vals(P.decode(e, "n", "d").select("id", "n", "d"), "id") == [(1, 2.0, "b"), (2, 1.0, "a"), (3, None, "")]
    with pytest.raises(P.DataError) as err:
        P.destring(df, ["t"])
    assert err.value.rc == 109
    assert vals(P.destring(df, ["t"], ["n"], ignore="$,").select("id", "n"), "id") == [(1, 1000.0), (2, None), (3, 2.0)]
    with pytest.raises(P.DataError):
        P.tostring(spark.createDataFrame([(1.234,)], "x double"), ["x"], decimals=1)
    assert P.set_obs(df, 5).count() == 5
    with pytest.raises(P.DataError):
        P.assert_true(df, F.col("x") > 5)
    P.assert_true(df, F.col("x") > 0)  # a missing condition passes


def test_by_group_and_numbers(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 1.0), ("b", 1, 2.0), (None, 1, 3.0)], "g string, t int, x double")
    b = WN.By("g", order=["t"])
    got = vals(df.select("g", "t", b.n(), b.N(), b.running_sum(F.col("x")), b.at(F.col("x"), -1)), F.col("g").asc_nulls_last(), "t")
    assert got == [("a", 1, 1, 3, 5.0, None), ("a", 2, 2, 3, 5.0, 5.0), ("a", 3, 3, 3, 6.0, None), ("b", 1, 1, 1, 2.0, None), (None, 1, 1, 1, 3.0, None)]
    n = WN.numbered(df.repartition(3), "-x", "g", "t")
    assert [r["x"] for r in n.orderBy("_n").collect()] == [None, 5.0, 3.0, 2.0, 1.0] and sorted(r["_n"] for r in n.collect()) == [1, 2, 3, 4, 5]
    assert WN.numbered(df.limit(0), "x").count() == 0


def test_egen(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double").withColumn("g", F.lit(1))
    x = F.col("x")
    got = df.select(*[WN.egen(s, x, ["g"]).alias(s) for s in ("median", "iqr", "p25", "p75")], WN.egen("pc", x, ["g"], p=10).alias("lo"), WN.egen("pc", x, ["g"], p=90).alias("hi")).first()
    assert tuple(got) == (5.5, 4.0, 3.0, 7.0, pytest.approx(1.9), pytest.approx(9.1))
    ties = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double").withColumn("g", F.lit(1))
    assert [r[0] for r in ties.select(WN.egen("rank", x, ["g"]).alias("r")).orderBy(F.col("r").asc_nulls_last()).collect()] == [1.0, 2.5, 2.5, None]
    some = df.select("x", WN.egen("mean", x, ["g"], x > 5).alias("m")).orderBy("x").collect()
    assert some[0]["m"] is None and some[9]["m"] == 8.0


def test_time_series_operators_against_a_dict(spark):
    rnd = random.Random(5)
    data = {(p, t): float(rnd.randint(0, 9)) for p in "ab" for t in range(30) if rnd.random() < 0.6}
    df = spark.createDataFrame([(p, t, x) for (p, t), x in data.items()] + [("a", None, 1.0)], "p string, t int, x double")
    pan = WN.Panel("t", "p")
    x = F.col("x")
    for p, t, v, l1, f2, d2, s3 in df.select("p", "t", "x", pan.L(x), pan.F(x, 2), pan.D(x, 2), pan.S(x, 3)).collect():
        if t is None:
            assert (l1, f2, d2, s3) == (None, None, None, None)
            continue
        g = lambda k: data.get((p, t - k))
        assert l1 == g(1) and f2 == g(-2)
        assert d2 == (None if None in (g(1), g(2)) else v - 2 * g(1) + g(2)) and s3 == (None if g(3) is None else v - g(3))
    assert list(pan.expand("L(1 3).x")) == ["L.x", "L3.x"] and list(pan.expand("L(0/2).x")) == ["x", "L.x", "L2.x"]


def test_differences_of_squares(spark):
    df = spark.createDataFrame([("A", t, float(t * t)) for t in range(1, 11)], "p string, t int, x double")
    pan = WN.Panel("t", "p")
    got = vals(df.select("t", pan.D(F.col("x")), pan.D(F.col("x"), 2), pan.D(F.col("x"), 3), pan.S(F.col("x"), 2)), "t")
    assert [r[1] for r in got[1:]] == [float(2 * t - 1) for t in range(2, 11)] and {r[2] for r in got[2:]} == {2.0} and {r[3] for r in got[3:]} == {0.0} and [r[4] for r in got[2:5]] == [8.0, 12.0, 16.0]


def test_merge(spark):
    m = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), (None, 3, 1.0), ("z", 4, 1.0)], "k string, id int, v double")
    u = spark.createDataFrame([("a", 7.0, "x"), (None, 8.0, "y"), ("q", 9.0, "w")], "k string, v double, e string")
    full = vals(MG.merge(m, u, "m:1", ["k"]), F.col("id").asc_nulls_last())
    assert full == [("a", 1, None, "x", 3.0), ("a", 2, 5.0, "x", 3.0), (None, 3, 1.0, "y", 3.0), ("z", 4, 1.0, None, 1.0), ("q", None, None, "w", 2.0)]
    assert [r[2] for r in vals(MG.merge(m, u, "m:1", ["k"], keep=["match"], update=True), "id")] == [7.0, 5.0, 1.0]
    assert [r[2] for r in vals(MG.merge(m, u, "m:1", ["k"], keep=[3], replace=True), "id")] == [7.0, 7.0, 8.0]
    for keep, n in ((["master"], 1), (["using"], 1), (["master", "using"], 2), (["using", "match"], 4)):
        assert MG.merge(m, u, "m:1", ["k"], keep=keep).count() == n
    for kind, rc in (("m:m", 198), ("1:1", 459)):
        with pytest.raises(P.DataError) as err:
            MG.merge(m, u, kind, ["k"])
        assert err.value.rc == rc
    with pytest.raises(P.DataError):
        MG.merge(m, u, "m:1", ["k"], check=["match"])
    assert MG.merge(m, u.limit(0), "m:1", ["k"]).filter("_merge = 1").count() == 4


def test_reshape_round_trip(spark):
    w = spark.createDataFrame([("a", "n1", 1.0, None), ("b", "n2", 3.0, 4.0)], "id string, name string, y1990 double, y1991 double")
    long = R.long(w, ["y"], ["id"], "t")
    assert vals(long, "id", "t") == [("a", 1990, 1.0, "n1"), ("a", 1991, None, "n1"), ("b", 1990, 3.0, "n2"), ("b", 1991, 4.0, "n2")]
    assert vals(R.wide(long, ["y"], ["id"], "t").select(*w.columns), "id") == vals(w, "id")
    s = spark.createDataFrame([("A", "X_ONE", 1.0), ("A", "Y_TWO", 2.0), ("B", "X_ONE", 3.0)], "id string, code string, v double")
    assert vals(R.wide(s, ["v"], ["id"], "code"), "id") == [("A", 1.0, 2.0), ("B", 3.0, None)]
    for bad, rc in ((s.union(s), 9), (s.withColumn("code", F.lit(None).cast("string")), 498), (s.withColumn("c", F.col("v")), 9)):
        with pytest.raises(P.DataError) as err:
            R.wide(bad, ["v"], ["id"], "code")
        assert err.value.rc == rc
    with pytest.raises(P.DataError) as err:
        R.long(w, ["zz"], ["id"], "t")
    assert err.value.rc == 111


def test_summaries(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(x, 2.0) for x in xs] + [(None, 1.0)], "x double, w double")
    r = A.summarize(df, ["x"], detail=True).first()
    m, sd = statistics.mean(xs), statistics.stdev(xs)
    assert (r["n"], r["mean"], r["min"], r["max"]) == (8, pytest.approx(m), 1.0, 9.0) and r["sd"] == pytest.approx(sd)
    assert r["skewness"] == pytest.approx(sum((x - m) ** 3 for x in xs) / 8 / sd**3) and r["kurtosis"] == pytest.approx(sum((x - m) ** 4 for x in xs) / 8 / sd**4) and r["p50"] == 3.5
    rep = statistics.stdev(xs + xs)
    assert A.summarize(df, ["x"], weight="w", kind="fweight").first()["sd"] == pytest.approx(rep)
    assert A.summarize(df, ["x"], weight="w").first()["sd"] == pytest.approx(sd)
    assert [r["value"] for r in A.extremes(df, "x").orderBy("side", "rank").collect()] == [9.0, 6.0, 5.0, 4.0, 1.0, 1.0, 2.0, 3.0]
    assert A.collapse(df.limit(0), {"s": ("sum", "x"), "m": ("mean", "x"), "n": ("count", "x")}).first() == (0.0, None, 0.0)
    t = A.tabulate(df, "x").filter("x is null").first()
    assert t["freq"] == 1 and t["percent"] == pytest.approx(100 / 9)
    tot = A.tabstat(df.withColumn("g", F.col("x") > 3), ["x"], ["mean", "iqr"], "g").filter("is_total = 1").first()
    assert tot["x_mean"] == pytest.approx(m)
    assert A.pwcorr(df, ["x", "w"]).first()["n"] == 8


def test_duplicates_boxes_bins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert vals(A.duplicates_drop(df, ["k"], ["id"]), "id") == [(1, "a"), (3, None), (5, "b")]
    assert {tuple(r) for r in A.duplicates_report(df, ["k"]).collect()} == {(2, 4, 2), (1, 1, 0)}
    with pytest.raises(P.DataError):
        A.isid(df, ["k"])
    b = A.box_stats(spark.createDataFrame([(float(i),) for i in [*range(1, 12), 100]], "x double"), "x").first()
    assert (b["q1"], b["median"], b["q3"], b["upper_adjacent"], b["n_outside"]) == (3.25, 6.5, 9.75, 11.0, 1)
    assert A.histogram_bins(df.select(F.col("id").cast("double").alias("x")), "x", 2).orderBy("bin").select("freq").collect() == [(2,), (3,)]
    assert A.histogram_bins(df.limit(0), "id").count() == 0 and not math.isnan(1)


def test_streaming_window(spark, tmp_path, sf):
    from tabulon.streaming.windows import tumbling

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "ts", "1 day", ["event_type"], "value", late="1 hour").writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = tumbling(events, "ts", "1 day", ["event_type"], "value")
    assert {(r[0], r[1], r[2]) for r in spark.table("days").collect()} == {(r[0], r[1], r[2]) for r in want.collect()}


def test_numbers_are_dense_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from tabulon.operators import window as WN

    x = spark.range(0, 2_000_000, 1, 6).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("k"), "id")
    n = WN.numbered(x, "k", "id").cache()
    low, high, distinct = n.agg(F.min("_n"), F.max("_n"), F.count_distinct("_n")).first()
    assert (low, high, distinct) == (1, 2_000_000, 2_000_000)
    wrong = n.alias("a").join(n.alias("b"), F.col("a._n") + 1 == F.col("b._n")).filter("a.k > b.k or (a.k = b.k and a.id > b.id)")
    assert wrong.isEmpty()
    ids = WN.group_id(x.withColumn("k", F.col("k") % 1000), ["k"], "g").agg(F.count_distinct("g"), F.max("g")).first()
    assert tuple(ids) == (1000, 1000)
    n.unpersist()


def test_weighted_percentiles(spark):
    from tabulon.operators import aggregate as A

    x = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 98), (9.0, 0), (None, 5)], "x double, w int")
    got = A.collapse(x, {"med": ("median", "x"), "p1": ("p1", "x")}, weight="w").first()
    assert got["med"] == 3.0 and abs(got["p1"] - 1.99) < 1e-9
    d = A.summarize(x, ["x"], weight="w", kind="fweight", detail=True).first()
    assert abs(d["sd"] ** 2 - d["variance"]) < 1e-12 and d["p50"] == 3.0
    t = A.tabstat(x.withColumn("g", x["w"] > 1), ["x"], ["mean", "median"], by="g", weight="w").filter("is_total = 1").first()
    assert abs(t["x_mean"] - 2.97) < 1e-9 and t["x_median"] == 3.0


def test_operator_chains(spark):
    from tabulon.operators import window as WN

    x = spark.createDataFrame([(1, t, float(t * t), float(t)) for t in (1, 2, 3, 4, 6)], "g int, t int, x double, y double")
    p = WN.Panel("t", "g")
    cols = p.expand("L(0/1)D.x") | p.expand("L.(x y)") | p.expand("F(1(2)3).y")
    assert list(cols) == ["D.x", "LD.x", "L.x", "L.y", "F.y", "F3.y"]
    got = {r["t"]: tuple(r)[4:] for r in x.select("*", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert got[4] == (7.0, 5.0, 9.0, 3.0, None, None) and got[3] == (5.0, 3.0, 4.0, 2.0, 4.0, 6.0) and got[6] == (None,) * 6
