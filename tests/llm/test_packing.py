"""Packing: nothing lost, nothing over capacity, splits only where needed, little space, mixture."""

import os

import pytest
from pyspark.sql import functions as F

from tabulon.llm import packing as P

CLASSES = "container_class string, capacity_tokens int"


def packed(spark, items, classes, **k):
    df = spark.createDataFrame(items, "key long, source string, n_tokens long")
    return P.pack(df, spark.createDataFrame(classes, CLASSES), **k)


def check(rows, items):
    size = {}
    for r in rows:
        size[r["container_class"], r["bucket"], r["container_no"]] = size.get((r["container_class"], r["bucket"], r["container_no"]), 0) + r["n_tokens"]
        assert r["n_tokens"] > 0
    cap = {r["container_class"]: r["capacity"] for r in rows}
    assert all(n <= cap[k[0]] for k, n in size.items())
    for c in cap:
        for key, _, n in items:
            own = sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in rows if r["container_class"] == c and r["key"] == key)
            assert sum(o[2] for o in own) == n and len(own) == -(-n // cap[c])
            assert [o[1] for o in own] == [i * cap[c] for i in range(len(own))]
    return size


def test_pack(spark):
    items = [(i, "abc"[i % 7 % 3], (i * 37) % 300 + (1000 if i % 50 == 0 else 0)) for i in range(1, 400)] + [(500, None, 0), (501, "a", 100)]
    items = [(k, s or "", n) for k, s, n in items]
    rows = packed(spark, items, [("s", 256), ("l", 4000), ("bad", 0)], bucket_items=150, window=4, window_items=1).collect()
    size = check(rows, items)
    assert {r["bucket"] for r in rows} == {0, 1, 2} and not [r for r in rows if r["key"] == 500]
    used = sum(n for k, n in size.items() if k[0] == "s")
    assert used / (256 * sum(k[0] == "s" for k in size)) > 0.95


def test_mixture_follows_the_target(spark):
    items = [(i, "big" if i % 3 else "small", 20) for i in range(3000)]
    rows = packed(spark, items, [("c", 200)], bucket_items=1000, window=10, window_items=1).collect()
    share, window = {}, {}
    for r in rows:
        share.setdefault((r["bucket"], r["window_no"]), []).append(r["source"] == "small")
        window.setdefault((r["bucket"], r["container_no"]), set()).add(r["window_no"])
    assert all(len(w) == 1 for w in window.values())  # a container belongs to one window
    full = [sum(v) / len(v) for v in share.values() if len(v) >= 100]
    assert len(full) > 20 and sum(abs(s - 1 / 3) for s in full) / len(full) < 0.03


def test_mixture_of_unequal_items(spark):
    sizes = [int(20 * 1.5 ** (i * 7919 % 11)) for i in range(4000)]
    items = [(i, "abc"[(i * i) % 7 % 3], n) for i, n in enumerate(sizes)]
    p = packed(spark, items, [("s", 300), ("l", 8000)], bucket_items=2000, window=8, window_items=256)
    m = P.mixture(p.withColumn("window", F.concat_ws("-", "bucket", "window_no"))).collect()
    assert all(r["mean_distance"] < 0.05 and r["n_windows"] > 5 for r in m), m


def test_deficit_is_carried():
    # a source that is owed tokens comes first
    got = P.fill([1, 2], [10, 10], ["a", "b"], {"a": 0.5, "b": 0.5}, {"b": 50.0}, 10, 1)
    assert got[0][0] == 2


def test_empty_and_odd(spark):
    assert packed(spark, [], [("c", 10)]).count() == 0
    assert packed(spark, [(1, "a", 5)], []).count() == 0
    assert packed(spark, [(1, "a", 25)], [("c", 10)]).count() == 3


@pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary file")
def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x", 5), (2, "Hello world", "x", 5), (3, None, None, 1), (4, "", "y", 1), (5, "word " * 5000, None, 1)], "doc_id long, text string, source string, n_tokens int")
    n = {r["key"]: r["n_tokens"] for r in P.token_counts(docs).collect()}
    assert n[1] == n[2] == 2 and n[3] == n[4] == 0 and n[5] > 4999
    out = P.pack_documents(docs, spark.createDataFrame([("small", 512)], CLASSES))
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 5}
    s = P.space(out).first()
    assert s["n_tokens"] == sum(n.values()) and s["unused"] < 0.1
    assert P.mixture(out).filter(F.col("mean_distance").between(0, 1)).count() == 1
