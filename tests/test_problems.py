"""Problems 1 to 6 on small fixtures: nulls, empty tables, ties, repeats, long cells, clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import eav, impute, references, regrid, reject, schema_drift

T0 = dt.datetime(2020, 1, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


# --- 1 -----------------------------------------------------------------------------

FILES = "file_id long, feed string, delivery_no int, received_at timestamp_ntz, extra string"
LINES = "file_id long, line_no int, raw_line string, names string"


def drift(spark, *files):
    f = spark.createDataFrame([(i, "f", i, T0, "x") for i in range(1, len(files) + 1)], FILES)
    lines = [(i, n, line, None) for i, text in enumerate(files, 1) for n, line in enumerate(text, 1)]
    return f, spark.createDataFrame(lines, LINES)


def test_changes(spark):
    a = ["SERIES_CODE,COUNTRY,SCALE,UPDATED,NOTE,2015", 'XAA.GD.A,"A, ""B"" C",Units,2020-01-05,n/a,"1,000.5"', "XAB.GD.A,Bee,Millions,2020-02-05,hi,--"]
    b = ["﻿ SERIESID ,Country,\"MULT\",UPDATED,2015,SECTOR", 'XAB.GD.A,Bee,Millions,05/02/2020,F,real', 'XAA.GD.A,"A, ""B"" C",,05/01/2020,1,real']
    f, lines = drift(spark, a, b, b)
    assert rows(schema_drift.found(f, lines)) == {(2, "SERIESID", "renamed"), (2, "Country", "renamed"), (2, "MULT", "renamed"), (2, "NOTE", "removed"), (2, "SECTOR", "added"), (2, "2015", "retyped")}
    t = {r["file_id"] * 10 + r["line_no"]: r for r in schema_drift.consistent_table(f, lines).collect()}
    assert t[12]["country"] == 'A, "B" C' and t[12]["obs"] == '{"2015":1000.5}' and t[22]["series_code"] == "XAB.GD.A"
    assert t[22]["updated"] == dt.date(2020, 2, 5) and t[22]["scale"] == "Millions"


def test_changes_of_nothing(spark):
    f, lines = drift(spark)
    assert rows(schema_drift.found(f, lines)) == set()
    f, lines = drift(spark, ["A,B"], ["A,C", None, "1,2"], ["A,C", "1"])
    assert rows(schema_drift.found(f, lines)) == {(2, "C", "added"), (2, "B", "removed")}


def test_changes_of_files_without_data_lines(spark):
    f, lines = drift(spark, ["A,B,B,", "1,x,y,z"], ["A,C"], ["a,C", "2,3"])
    assert rows(schema_drift.found(f, lines)) == {(2, "C", "added"), (2, "B", "removed"), (3, "a", "renamed")}
    assert {r["file_id"] for r in schema_drift.consistent_table(f, lines).collect()} == {1, 3}


def test_renames_of_equal_columns_are_all_found(spark):
    f, lines = drift(spark, ["SERIES_CODE,P,Q,R", "XAA.GD.A,1,1,5", "XAB.GD.A,2,2,6"], ["SERIES_CODE,X,Y,S", "XAA.GD.A,1,1,7", "XAB.GD.A,2,2,8"])
    assert rows(schema_drift.found(f, lines)) == {(2, "X", "renamed"), (2, "Y", "renamed"), (2, "S", "added"), (2, "R", "removed")}


def test_a_file_without_header_is_recorded_and_passed_over(spark):
    f, lines = drift(spark, ["ISO,A", "XAA,1"], [None, "x,y"], ["ISO,B", "XAA,2"])
    assert rows(schema_drift.found(f, lines)) == {(3, "B", "added"), (3, "A", "removed")}
    reg = schema_drift.registry(schema_drift.Drift(f, lines))
    assert rows(reg.select("file_id", "version_no", "step", "field_name")) == {(1, 1, "first", None), (2, None, "unreadable", None), (3, 2, "default", "B"), (3, 2, "drop", "A")}


def test_migration_steps(spark):
    f, lines = drift(spark, ["ISO,COUNTRY,UPDATED,2015", "XAA,Aa,2020-01-05,1"], ["ISO,Land,UPDATED,2015", "XAA,Aa,05/01/2020,1"])
    got = rows(schema_drift.migration_steps(f, lines).filter("file_id = 2 and step <> 'default'").select("step", "field_name", "target", "rule"))
    assert got == {("rename", "ISO", "iso", "text"), ("rename", "Land", "country", "text"), ("rename", "UPDATED", "updated", "date"), ("rename", "2015", "@2015", "number"), ("cast", "UPDATED", "updated", "date"), ("cast", "2015", "@2015", "number")}
    lacks = {r["target"] for r in schema_drift.migration_steps(f, lines).filter("file_id = 2 and step = 'default'").collect()}
    assert lacks == set(schema_drift.CANONICAL) - {"iso", "country", "updated"}


# --- 2 -----------------------------------------------------------------------------

PANEL = "row_id long, country string, year double, gdp double, pop double, currency string, loaded_at timestamp_ntz"
REGIONS = "row_id long, country string, region string, income_grp string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_fill(spark):
    nan = float("nan")
    p = [(1, "AA", 2000.0, 10.0, nan, "QAA", T0), (2, " aa\t", 2001.0, -1.0, 2.0, "na", T0), (3, "ZZ", 2000.0, None, 1.0, None, T0), (4, None, None, None, None, None, None), (5, "BB", 2000.0, 1e13, 0.0, "x", T0), (5, "BB", 2000.0, 1e13, 0.0, "x", T0)]
    r = spark.createDataFrame([(1, "Aa", "r", "", T0, None), (2, "BB", None, None, None, None)], REGIONS)
    g = spark.createDataFrame([(1, 1.0, 1990.0, 5.0, 1.0, 1.0), (2, 1.0, nan, nan, 1.0, 1.0), (3, None, 1990.0, None, 1.0, 1.0)], "row_id long, firm double, year double, invest double, value double, capital double")
    panel = spark.createDataFrame(p, PANEL)
    assert rows(impute.found(panel, r, g)) == {("panel", 1, "pop"), ("panel", 2, "gdp"), ("panel", 2, "currency"), ("grunfeld", 2, "invest")}
    full = {x["row_id"]: x for x in impute.fill_panel(panel, r).collect()}
    assert full[2]["currency_filled"] == "QAA" and full[2]["gdp_filled"] > 0 and full[2]["gdp"] == -1.0
    assert full[3]["currency_mask"] == "time" and full[4]["gdp_filled"] is None
    assert rows(impute.found(panel.limit(0), r.limit(0), g.limit(0))) == set()


def test_fill_beats_the_mean(spark):
    random.seed(1)
    rs, truth = [], {}
    for g in range(60):
        u = random.gauss(0, 1)
        for t in range(20):
            y = 2.718 ** (3 + u + 0.05 * t + random.gauss(0, 0.05))
            hide = random.random() < 0.15
            i = g * 20 + t
            if hide:
                truth[i] = y
            rs.append((i, float(g), 1990.0 + t, None if hide else y, 1.0, 1.0))
    g = spark.createDataFrame(rs, "row_id long, firm double, year double, invest double, value double, capital double")
    out = {r["row_id"]: r["invest_filled"] for r in impute.fill_grunfeld(g).filter("invest_mask = 'group'").collect()}
    means = {r["firm"]: r["m"] for r in g.groupBy("firm").agg(F.avg("invest").alias("m")).collect()}
    mixed = sum(abs(out[i] / y - 1) for i, y in truth.items())
    plain = sum(abs(means[i // 20] / y - 1) for i, y in truth.items())
    assert set(out) == set(truth) and mixed < 0.5 * plain


def test_categories_follow_group_and_time(spark):
    random.seed(2)
    rs, truth = [], {}
    for g in range(40):
        old, new = f"O{chr(65 + g % 26)}{chr(65 + g // 26)}", "EUR"
        for t in range(20):  # most groups change to EUR about year 10
            c = new if t >= 10 + (g % 3 - 1) and g % 5 else old
            hide = random.random() < 0.2
            if hide:
                truth[g * 20 + t] = c
            rs.append((g * 20 + t, f"G{g}", 2000.0 + t, 1.0, 1.0, None if hide else c, T0))
    r = spark.createDataFrame([(g, f"G{g}", "r", "", T0, None) for g in range(40)], REGIONS)
    out = {x["row_id"]: x["currency_filled"] for x in impute.fill_panel(spark.createDataFrame(rs, PANEL), r).filter("currency_mask = 'group'").collect()}
    assert set(out) == set(truth) and sum(out[i] == c for i, c in truth.items()) > 0.85 * len(truth)


def test_ties_between_categories_go_to_the_first(spark):
    p = [(1, "AA", 2000.0, 1.0, 1.0, "ZZZ", T0), (2, "AA", 2000.0, 1.0, 1.0, "AAA", T0), (3, "AA", 2000.0, 1.0, 1.0, None, T0), (4, "BB", 2000.0, 1.0, 1.0, "", T0), (5, None, 2000.0, 1.0, 1.0, "", T0)]
    r = spark.createDataFrame([(1, "AA", "r", "", T0, None), (2, "BB", "r", "", T0, None)], REGIONS)
    out = {x["row_id"]: (x["currency_filled"], x["currency_mask"]) for x in impute.fill_panel(spark.createDataFrame(p, PANEL), r).collect()}
    assert out[3] == ("AAA", "group") and out[4] == ("AAA", "time") and out[5] == ("AAA", "time") and out[1] == ("ZZZ", None)


# --- 3 -----------------------------------------------------------------------------


def test_reject(spark):
    lines = ["country;year;gdp;pop", "AA-1;1990;1,000.5;n/a", '"A ""x""\nB";2000;"-1e3";.', "AA;1990;1", 'AA;1990;"1"x;2', "?;1990;1;2", "NA;1990;1;2", "AA;1990.5;1;2", "AA;2101;1;2", "A�A;1990;1;2", "AA;1990;1 2;2", "AA;1990;1;2;", "", None, "A" * 50_000 + ";1990;1;2", '"' + "é" * 20_000]
    r = spark.createDataFrame([(1, i, "panel", x, "c") for i, x in enumerate(lines, 1)] + [(2, 2, "x", "1,2", "c")], "file_id long, line_no int, file_name string, raw_line string, fields string")
    bad = {(x["file_id"], x["line_no"]): (x["reason"], x["field"]) for x in reject.rejected(r).collect()}
    assert bad == {(1, 4): ("column_count", "pop"), (1, 5): ("quoting", "gdp"), (1, 6): ("bad_value", "country"), (1, 7): ("bad_value", "country"), (1, 8): ("bad_value", "year"), (1, 9): ("bad_value", "year"), (1, 10): ("bad_value", "country"), (1, 11): ("bad_value", "gdp"), (1, 12): ("column_count", None), (1, 13): ("column_count", "country"), (1, 14): ("column_count", "country"), (1, 16): ("quoting", "country"), (2, 2): ("column_count", None)}
    ok = {x["line_no"]: x for x in reject.valid(r).collect()}
    assert ok[2]["gdp"] == 1000.5 and ok[2]["pop"] is None and ok[3]["country"] == 'A "x"\nB' and ok[3]["gdp"] == -1000.0 and 15 in ok
    assert reject.rejected(r.limit(0)).count() == 0


# --- 4 -----------------------------------------------------------------------------


def test_orphans(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    parent = spark.createDataFrame([(1, "AA", "r", "", day(0), day(10)), (2, "aa ", "r", "", day(20), None), (3, "BB", "r", "", None, None), (4, None, None, None, day(0), None)], REGIONS)
    child = spark.createDataFrame([(1, "AA", day(5)), (2, "AA", day(10)), (3, "\tAa", day(25)), (4, "AA", day(-1)), (5, "CC", day(0)), (6, None, day(0)), (7, " ", day(0)), (8, "BB", day(-9)), (9, "CC", None), (10, "AA", None), (5, "CC", day(0))], "row_id long, country string, loaded_at timestamp_ntz")
    got = references.orphans(child, "panel", "country", "row_id", "loaded_at", parent, "country")
    assert sorted((r["row_id"], r["kind"]) for r in got.collect()) == [(2, "deleted"), (4, "late"), (5, "missing"), (5, "missing"), (9, "missing")]
    assert references.orphans(child, "p", "country", "row_id", "loaded_at", parent.limit(0), "country").filter("kind <> 'missing'").count() == 0
    assert rows(references.counts(got).filter("kind = 'missing'")) == {("panel", "country", "missing", "2020-01", 2), ("panel", "country", "missing", None, 1)}


# --- 5 -----------------------------------------------------------------------------

OBS = "obs_id long, vintage int, series_code string, weo_subject_code string, iso string, yr int, val string, loaded_at timestamp_ntz, slot int"


def test_wide(spark):
    later = T0 + dt.timedelta(days=1)
    o = [
        (1, 1, "XAA. GD .A", None, None, 2000, "1,234.5", T0, 0), (2, 1, "xaa.gd.a", None, None, 2000, "7", later, 0), (3, 1, "XAA.GD.A", None, None, 2000, "8", later, 0), (4, 1, "XAA.GD.Q", None, None, 2000, "9", later, 0),
        (5, 2, None, "gd", " xaa", 2000, "n/a", T0, 0), (6, 2, None, "REV_DATE", "XAA", 2000, "2020-02-30", T0, 0), (7, 2, None, "METHOD", "XAA", 2000, " 5 ", None, 0), (8, 2, None, "EST_AFTER", "XAA", 2000, "2010", T0, 0), (9, None, None, "GD", "XAA", 2000, "1", T0, 0), (10, 2, None, None, "XAA", 2000, "1", T0, 0),
    ]
    obs = spark.createDataFrame(o, OBS)
    assert rows(eav.found(obs)) >= {(1, "XAA", 2000, "GD", 2), (2, "XAA", 2000, "METHOD", 7), (2, "XAA", 2000, "EST_AFTER", 8)}
    w = {r["vintage"]: r for r in eav.wide(obs)[0].collect()}
    assert w[1]["GD"] == 7.0 and w[2]["GD"] is None and w[2]["METHOD"] == "5" and w[2]["EST_AFTER"] == 2010 and w[2]["REV_DATE"] is None
    assert eav.found(obs.limit(0)).count() == 0 and eav.wide(obs.limit(0))[0].count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    o = [(i, rnd.randint(1, 2), None, rnd.choice(["GD", "PO", "KX"]), rnd.choice(["AAA", "AAA", "BBB"]), rnd.randint(2000, 2003), rnd.choice(["1", "2.5", "", None, "see"]), T0 + dt.timedelta(days=rnd.randint(0, 2)), 0) for i in range(400)]
    best = {}
    for i, v, _, c, iso, y, val, t, _ in o:
        k = (v, iso, y, c)
        if k not in best or (t, -i) > best[k][0]:
            best[k] = ((t, -i), i, val)
    want = {(*k, i) for k, (_, i, val) in best.items() if val in ("1", "2.5")}
    assert rows(eav.found(spark.createDataFrame(o, OBS).repartition(7))) == want


# --- 6 -----------------------------------------------------------------------------


def test_a_null_reading_ends_the_one_before(spark):
    r = spark.createDataFrame([("a", 0, 0.0, 1, 10.0), ("a", 0, 0.9, 2, None), ("a", 3, 0.5, 3, 2.0)], "source string, period long, frac double, tie long, value double")
    got = {x["period"]: (x["value"], round(x["coverage"], 6)) for x in regrid.step_grid(r).collect()}
    assert got == {0: (10.0, 0.9), 1: (None, 0.0), 2: (None, 0.0), 3: (2.0, 0.5)}


def test_grid(spark):
    at = lambda y, m, d: dt.datetime(y, m, d)
    a = [(1, "aa", 2000.0, 11.0, 10.0, at(2000, 11, 16)), (2, " AA", 2001.0, 2.0, 20.0, at(2001, 2, 1)), (3, "AA", 2001.0, 2.0, 40.0, at(2001, 2, 15)), (4, "AA", 2001.0, 13.0, 5.0, at(2001, 2, 1)), (5, "AA", 2005.0, 1.0, float("nan"), at(2005, 1, 1)), (6, "AA", 2005.0, 1.0, -9.0, at(2005, 1, 1)), (7, None, 2000.0, 1.0, 1.0, None), (8, "BB", 2000.0, 1.0, 1.0, None), (9, "BB", 2000.0, 1.5, 1.0, None)]
    g = regrid.airline_grid(spark.createDataFrame(a, "row_id long, carrier string, year double, month double, passengers double, read_at timestamp_ntz"))
    got = {(r["source"], r["period"]): r for r in g.collect()}
    assert [k for k in sorted(got) if got[k]["is_filled"]] == [("AA", 200012), ("AA", 200101)]
    assert got["AA", 200101]["value"] == 10.0 and got["AA", 200101]["coverage"] == 0.0 and 0.4 < got["AA", 200012]["coverage"] < 0.6
    assert 29 < got["AA", 200102]["value"] < 31 and got["BB", 200001]["n_readings"] == 1 and len(got) == 5
    assert g.limit(0).count() == 0


def test_panel_grid(spark):
    p = spark.createDataFrame([(1, "AA", 2000.0, 1.0, 1.0, "Q", T0), (2, "AA", 2000.0, 3.0, 1.0, "Q", T0 + dt.timedelta(days=1)), (3, "aa ", 2003.0, None, 1.0, "Q", T0), (4, "ZZ", 2000.0, 1.0, 1.0, "Q", T0), (5, "ZZ", 2005.0, 1.0, 1.0, "Q", T0), (6, "AA", None, 1.0, 1.0, "Q", T0)], PANEL)
    r = spark.createDataFrame([(1, "AA", "r", "", T0, T0)], REGIONS)
    got = {x["period"]: x for x in regrid.panel_grid(p, r).collect()}
    assert sorted(got) == [2000, 2001, 2002, 2003] and [k for k in got if got[k]["is_filled"]] == [2001, 2002]
    assert got[2000]["value"] == 3.0 and got[2001]["value"] == 3.0
    assert regrid.panel_grid(p.limit(0), r).count() == 0


def test_complete_rows_are_spread_when_filled(spark):
    rows = spark.range(20_000).selectExpr("'A' k", "2000 + cast(id % 3 as int) y", "if(id % 100 = 0, null, id + 1.0) v")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = impute.mixed_fill(rows, F.col("k"), F.col("y"), ["v"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
    assert out.filter("v_mask = 'group'").count() == 200 and out.filter("v_filled is null").isEmpty()
