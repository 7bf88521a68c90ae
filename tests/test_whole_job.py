"""Operators on tables large enough to be split, and over all their rows."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabulon.operators import aggregate as A
from tabulon.operators import window as WN


@pytest.fixture
def split(spark):
    """Keeps the partitions of small tables apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_a_table_larger_than_the_range_sample(split):
    df = split.range(0, 60_000, 1, 6).select(((F.col("id") * 7919) % 60_000).alias("x"), (F.col("id") % 3).alias("g"))
    n = WN.numbered(df, "x")
    assert n.filter(F.col("_n") != F.col("x") + 1).count() == 0 and n.filter("_n is null").count() == 0
    assert n.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["x"] for r in WN.in_range(df, 30_001, 30_010, "x").collect()) == list(range(30_000, 30_010))
    g = WN.group_id(df.withColumn("k", F.floor(F.col("x") / 2)), ["k"], "no")
    assert g.filter(F.coalesce(F.col("no"), F.lit(-1)) != F.col("k") + 1).count() == 0


def test_reshape_of_all_orders_of_all_years(spark, sf):
    q = entry.queries()
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    years = sorted(r[0] for r in orders.select(F.year("o_orderdate")).distinct().collect())
    w = q["reshape_wide_customers"](spark, sf)
    assert w.columns == ["o_custkey", *[f"{s}{y}" for y in years for s in ("price", "cnt")]]
    cells = sum(F.coalesce(F.col(f"cnt{y}"), F.lit(0.0)) for y in years)
    customers = orders.select("o_custkey").distinct().count()
    assert w.count() == customers and w.agg(F.sum(cells)).first()[0] == orders.count()
    long = q["reshape_long_customers"](spark, sf)
    assert long.count() == customers * len(years) and long.agg(F.sum("cnt")).first()[0] == orders.count()


def test_rank_rules_against_python(split):
    rnd = random.Random(3)
    data = [(g, None if rnd.random() < 0.05 else float(round(rnd.expovariate(0.01), 1))) for g in ("a", "b", None) for _ in range(1500)] + [("one", 2.0), ("two", 1.0), ("two", 3.0), ("gone", None)]
    df = split.createDataFrame([(i, g, x) for i, (g, x) in enumerate(data)], "id int, g string, x double").repartition(6)
    groups = {}
    for g, x in data:
        groups.setdefault(g, []).extend([x] if x is not None else [])
    for v in groups.values():
        v.sort()
    near = lambda v, p: v[int(p * (len(v) - 1))] if v else None
    got = WN.egen_join(df, {"q1": ("p25", "x"), "q3": ("p75", "x"), "iqr": ("iqr", "x")}, ["g"], rule="nearest").collect()
    assert len(got) == len(data)
    for r in got:
        v = groups[r["g"]]
        assert (r["q1"], r["q3"], r["iqr"]) == (near(v, 0.25), near(v, 0.75), near(v, 0.75) - near(v, 0.25) if v else None)
    got = WN.egen_rank(df, "x", ["g"], "r").collect()
    assert len(got) == len(data)
    for r in got:
        v = groups[r["g"]]
        assert r["r"] == (None if r["x"] is None else (bisect.bisect_left(v, r["x"]) + 1 + bisect.bisect_right(v, r["x"])) / 2)

    def np1(v, p):
        h = (len(v) + 1) * p
        k = max(1, min(int(h), len(v)))
        return v[k - 1] + max(0.0, min(1.0, h - k)) * (v[min(k, len(v) - 1)] - v[k - 1])

    boxes = {r["g"]: r for r in A.box_stats(df, "x", ["g"]).collect()}
    assert set(boxes) == {"a", "b", None, "one", "two"}
    for g, b in boxes.items():
        v, (q1, m, q3) = groups[g], (np1(groups[g], p) for p in (0.25, 0.5, 0.75))
        inside = [x for x in v if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        assert (b["n"], b["n_outside"], b["lower_adjacent"], b["upper_adjacent"]) == (len(v), len(v) - len(inside), inside[0], inside[-1])
        assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, m, q3))


@pytest.mark.parametrize("name", ["box_stats", "egen_nearest", "egen_window", "egen_rank"])
def test_no_window_holds_a_whole_group(spark, sf, name):
    """Every window of the plan is over buckets or inside one."""
    text = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in text.splitlines() if re.search(r"\bWindow \[", x)]
    assert windows and all(re.search(r"\bb#\d+", x) for x in windows)


def test_merges_of_every_order_and_customer(spark, sf):
    q = entry.queries()
    orders, customers = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "customer"))
    full = q["merge_whole_m1_full"](spark, sf)
    n = {r["_merge"]: r["count"] for r in full.groupBy("_merge").count().collect()}
    assert set(n) == {1.0, 2.0, 3.0} and n[1.0] + n[3.0] == orders
    assert full.filter("o_orderkey is null").count() + full.filter("_merge = 3").select("custkey").distinct().count() == customers
    got = {k: q[f"merge_whole_{k}"](spark, sf).count() for k in ("keep_match", "keep_master_match", "keep_master", "1m")}
    assert got == {"keep_match": n[3.0], "keep_master_match": orders, "keep_master": n[1.0], "1m": n[2.0] + n[3.0]}
    assert q["merge_whole_update"](spark, sf).count() == customers + spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 2 = 1").count()
