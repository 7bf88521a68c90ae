"""Queries of the data-preparation and statistics operators with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import dates as D
from tabulon.functions import missing as M
from tabulon.functions import numeric as N
from tabulon.functions import strings as S
from tabulon.operators import aggregate as A
from tabulon.operators import merge as MG
from tabulon.operators import prep as P
from tabulon.operators import reshape as R
from tabulon.operators import window as WN
from tabulon.session import shared_folder, table
from tabulon.sources import files

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


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """events with some values missing: the tables themselves have none."""
    e = table(spark, d, "events")
    return e.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


GAPPY = "(select *, case when event_id % 7 <> 0 then value end as v from events)"


def user_days(spark: SparkSession, d: str) -> DataFrame:
    """The user by day panel of events, with gaps."""
    e = table(spark, d, "events").select("user_id", D.days("ts").alias("day"), "value")
    return A.collapse(e, {"x": ("sum", "value"), "n": ("count", "value")}, ["user_id", "day"])


USER_DAYS = "(select user_id, cast(date_diff('day', date '1960-01-01', cast(ts as date)) as double) as day, sum(value) as x, cast(count(value) as double) as n from events group by 1, 2)"


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_extendedprice), 4) as avg_price, cast(count(*) as double) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    x = P.keep_if(table(spark, d, "lineitem"), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    x = P.generate(x, "disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    x = A.collapse(x, {"sum_qty": ("sum", "l_quantity"), "sum_disc_price": ("sum", "disc_price"), "avg_price": ("mean", "l_extendedprice"), "n": ("count", "l_quantity")}, ["l_returnflag", "l_linestatus"])
    return x.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_disc_price": F.round("sum_disc_price", 2), "avg_price": F.round("avg_price", 4)})


@query(f"select event_id, v from {GAPPY} where v > 60 or v is null")
def keep_if_missing_gt(spark, d):
    return P.keep_if(gappy(spark, d), M.gt("v", 60)).select("event_id", "v")


@query(f"select event_id, v from {GAPPY} where v < 20")
def keep_if_missing_lt(spark, d):
    return P.keep_if(gappy(spark, d), M.lt("v", 20)).select("event_id", "v")


@query(f"select event_id, v from {GAPPY} where not coalesce(v <= 50 and user_id < 40, false)")
def drop_if_and(spark, d):
    return P.drop_if(gappy(spark, d), M.and_(M.le("v", 50), F.col("user_id") < 40)).select("event_id", "v")


@query("select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end as urgent, case when o_totalprice between 50000 and 150000 then 1.0 else 0.0 end as middle, case when o_totalprice > 100000 then 'big' else 'small' end as size from orders")
def gen_cond_inrange_inlist(spark, d):
    x = table(spark, d, "orders")
    x = P.generate(x, "urgent", M.num(M.inlist("o_orderpriority", "1-URGENT", "2-HIGH")))
    x = P.generate(x, "middle", M.num(M.inrange("o_totalprice", 50000, 150000)))
    return P.generate(x, "size", F.when(M.gt("o_totalprice", 100000), "big").otherwise("small")).select("o_orderkey", "urgent", "middle", "size")


@query(f"select event_id, case when event_id % 3 = 0 then 0.0 when event_id % 7 <> 0 then value * 2 end as y from events")
def gen_replace(spark, d):
    x = P.generate(gappy(spark, d), "y", F.col("v") * 2)
    return P.replace(x, "y", F.lit(0.0), F.col("event_id") % 3 == 0).select("event_id", "y")


@query("select p_partkey, octet_length(encode(p_name)) as len, upper(p_name) as up, instr(p_name, 'i') as pos, substr(p_name, 2, 3) as mid, replace(p_name, 'e', '_') as sub, string_split(p_name, ' ')[1] as w1, string_split(p_name, ' ')[-1] as wl, cast(len(string_split(p_name, ' ')) as int) as nw, reverse(p_brand) as rev, case when length(p_name) > 6 then substr(p_name, 1, 5) || '~' else p_name end as abb, repeat(p_type, 2) as dup from part")
def string_funcs(spark, d):
    x = table(spark, d, "part")
    return x.select("p_partkey", S.strlen("p_name").alias("len"), S.upper("p_name").alias("up"), S.strpos("p_name", "i").alias("pos"), S.substr("p_name", F.lit(2), F.lit(3)).alias("mid"), S.subinstr("p_name", "e", "_").alias("sub"), S.word("p_name", 1).alias("w1"), S.word("p_name", -1).alias("wl"), S.wordcount("p_name").alias("nw"), S.reverse("p_brand").alias("rev"), S.abbrev("p_name", 6).alias("abb"), S.strdup("p_type", 2).alias("dup"))


@query("select p_partkey, p_brand like 'Brand#%' as is_brand, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) as no, regexp_replace(p_brand, '[#0-9]+', '') as bare, regexp_replace(p_name, '[aeiou]', '*') as first_vowel, p_type like 'E%Y' as glob from part")
def regex_funcs(spark, d):
    x = table(spark, d, "part")
    return x.select("p_partkey", S.regexm("p_brand", "^Brand#").alias("is_brand"), S.regexs("p_brand", "([A-Za-z]+)#([0-9]+)", 2).alias("no"), S.regexr("p_brand", "[#0-9]+", "").alias("bare"), S.regexr("p_name", "[aeiou]", "*").alias("first_vowel"), S.strmatch("p_type", "E*Y").alias("glob"))


@query("select doc_id, lower(trim(court, e' \\t')) as c, regexp_replace(coalesce(case_no, ''), '[^A-Za-z0-9_]', '_', 'g') as nm, coalesce(lang, '') || ':' || coalesce(source, '') as both, n_chars > 1000 as long from documents")
def text_columns(spark, d):
    x = table(spark, d, "documents")
    name = S.strtoname("case_no")
    return x.select("doc_id", S.lower(S.trim("court")).alias("c"), F.when(name.startswith("_"), F.substring(name, F.lit(2), F.length(name))).otherwise(name).alias("nm"), S.concat("lang", F.lit(":"), "source").alias("both"), (F.col("n_chars") > 1000).alias("long"))


_DAY = "cast(o_orderdate as date)"


@query(f"select o_orderkey, cast(year({_DAY}) as double) as y, cast(month({_DAY}) as double) as m, cast(day({_DAY}) as double) as dd, cast(quarter({_DAY}) as double) as q, cast(dayofyear({_DAY}) as double) as doy, cast(dayofweek({_DAY}) as double) as dow, cast(least((dayofyear({_DAY}) - 1) // 7 + 1, 52) as double) as wk from orders")
def date_parts(spark, d):
    x = table(spark, d, "orders").withColumn("t", D.days("o_orderdate"))
    return x.select("o_orderkey", D.year("t").alias("y"), D.month("t").alias("m"), D.day("t").alias("dd"), D.quarter("t").alias("q"), D.doy("t").alias("doy"), D.dow("t").alias("dow"), D.week("t").alias("wk"))


@query(f"select o_orderkey, cast((year({_DAY}) - 1960) * 12 + month({_DAY}) - 1 as double) as mm, cast((year({_DAY}) - 1960) * 4 + quarter({_DAY}) - 1 as double) as qq, cast(date_diff('day', date '1960-01-01', cast(date_trunc('month', o_orderdate) as date)) as double) as dm, cast(date_diff('day', date '1960-01-01', cast(date_trunc('quarter', o_orderdate) as date)) as double) as dq, cast(date_diff('day', date '1960-01-01', {_DAY}) as double) as rebuilt, cast((year({_DAY}) - 1960) * 4 + quarter({_DAY}) - 1 as double) as parsed from orders")
def period_convert(spark, d):
    x = table(spark, d, "orders").withColumn("t", D.days("o_orderdate"))
    text = F.concat_ws("-Q", F.year("o_orderdate"), F.quarter("o_orderdate"))
    return x.select("o_orderkey", D.mofd("t").alias("mm"), D.qofd("t").alias("qq"), D.dofm(D.mofd("t")).alias("dm"), D.dofq(D.qofd("t")).alias("dq"), D.mdy(D.month("t"), D.day("t"), D.year("t")).alias("rebuilt"), D.quarterly(text).alias("parsed"))


@query("select event_id, round(case when value - 50 > 0 then ln(value - 50) end, 6) as l, round(case when value - 50 >= 0 then sqrt(value - 50) end, 6) as r, trunc(value - 50) + 0.0 as i, round(fmod(value, 7), 6) as md, round(value / nullif(event_id % 5, 0), 6) as dv, round(value - 50) + 0.0 as rd, round(exp(value / 100), 6) as e, greatest(value, 50) as mx, least(value, 50) as mn from events")
def math_funcs(spark, d):
    x = table(spark, d, "events").withColumn("c", F.col("value") - 50)
    return x.select("event_id", F.round(N.ln("c"), 6).alias("l"), F.round(N.sqrt("c"), 6).alias("r"), (N.trunc_int("c") + 0.0).alias("i"), F.round(N.mod("value", F.lit(7.0)), 6).alias("md"), F.round(N.div("value", F.col("event_id") % 5), 6).alias("dv"), N.round_to("c").alias("rd"), F.round(N.exp(F.col("value") / 100), 6).alias("e"), M.max_of("value", F.lit(50.0)).alias("mx"), M.min_of("value", F.lit(50.0)).alias("mn"))


@query("select c_custkey, round(exp(-z * z / 2) / sqrt(2 * pi()), 6) as den, round(-z * z / 2 - 0.5 * ln(2 * pi()), 6) as lnden from (select *, c_acctbal / 5000 as z from customer)")
def density_funcs(spark, d):
    z = F.col("c_acctbal") / 5000
    return table(spark, d, "customer").select("c_custkey", F.round(N.normalden(z), 6).alias("den"), F.round(N.lnnormalden(z), 6).alias("lnden"))


@query()
def distribution_funcs(spark, d):
    """Normal, t, F and chi-squared values of every balance."""
    z = F.col("c_acctbal") / 5000
    x = table(spark, d, "customer")
    return x.select("c_custkey", N.normal(z).alias("p"), N.lnnormal(z).alias("lp"), N.invnormal(N.normal(z)).alias("z"), N.ttail(F.lit(10.0), z).alias("t"), N.chi2(F.lit(3.0), F.abs(z)).alias("x2"), N.ftail(F.lit(2.0), F.lit(9.0), F.abs(z)).alias("f"))


_BY = "over (partition by o_custkey order by o_orderdate, o_orderkey)"


@query(f"select o_orderkey, row_number() {_BY} as i, count(*) over (partition by o_custkey) as n from orders")
def by_n_N(spark, d):
    b = WN.By("o_custkey", order=["o_orderdate", "o_orderkey"])
    return table(spark, d, "orders").select("o_orderkey", b.n().alias("i"), b.N().alias("n"))


@query(f"select o_orderkey, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) {_BY}, 2) as run from orders")
def by_running_sum(spark, d):
    b = WN.By("o_custkey", order=["o_orderdate", "o_orderkey"])
    return table(spark, d, "orders").select("o_orderkey", F.round(b.running_sum(F.col("o_totalprice"), F.col("o_orderstatus") == "F"), 2).alias("run"))


@query("select o_orderkey, first_value(o_totalprice) over w as a, last_value(o_totalprice) over w as z, nth_value(o_totalprice, 2) over w as b from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)")
def by_first_last(spark, d):
    b = WN.By("o_custkey", order=["o_orderdate", "o_orderkey"])
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", b.first(x).alias("a"), b.last(x).alias("z"), b.nth(x, 2).alias("b"))


@query(f"select o_orderkey, lag(o_totalprice) {_BY} as before, lead(o_totalprice, 2) {_BY} as after2 from orders")
def by_lag(spark, d):
    b = WN.By("o_custkey", order=["o_orderdate", "o_orderkey"])
    return table(spark, d, "orders").select("o_orderkey", b.at(F.col("o_totalprice"), -1).alias("before"), b.at(F.col("o_totalprice"), 2).alias("after2"))


@query("select p_partkey, round(avg(p_retailprice) over w, 4) as mean, round(stddev_samp(p_retailprice) over w, 4) as sd, round(sum(p_retailprice) over w, 2) as total, cast(count(*) over w as double) as n, min(p_retailprice) over w as lo, max(p_retailprice) over w as hi, round(quantile_cont(p_retailprice, 0.5) over w, 4) as med, round(quantile_cont(p_retailprice, 0.9) over w, 4) as p90 from part window w as (partition by p_brand)")
def egen_stats(spark, d):
    x = "p_retailprice"
    g = WN.egen_join(table(spark, d, "part"), {"mean": ("mean", x), "sd": ("sd", x), "total": ("sum", x), "n": ("count", x), "lo": ("min", x), "hi": ("max", x), "med": ("median", x), "p90": ("p90", x)}, ["p_brand"])
    return g.select("p_partkey", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("total", 2).alias("total"), "n", "lo", "hi", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))


@query("select event_id, round(avg(case when event_type <> 'error' then v end) over (partition by user_id), 6) as m, round(quantile_cont(v, 0.5) over (partition by user_id), 6) as med from " + GAPPY)
def egen_window(spark, d):
    """With a condition on the rows."""
    e = gappy(spark, d)
    e = e.withColumn("some", F.when(F.col("event_type") != "error", F.col("v")))
    g = WN.egen_join(e, {"m": ("mean", "some"), "med": ("median", "v")}, ["user_id"])
    return g.select("event_id", F.round("m", 6).alias("m"), F.round("med", 6).alias("med"))


@query("select p_partkey, l[1 + (n - 1) // 4] as q1, l[1 + 3 * (n - 1) // 4] as q3, round(l[1 + 3 * (n - 1) // 4] - l[1 + (n - 1) // 4], 6) as iqr from (select p_partkey, list_sort(list(p_retailprice) over (partition by p_brand)) as l, count(*) over (partition by p_brand) as n from part)")
def egen_nearest(spark, d):
    x = "p_retailprice"
    g = WN.egen_join(table(spark, d, "part"), {"q1": ("p25", x), "q3": ("p75", x), "iqr": ("iqr", x)}, ["p_brand"], rule="nearest")
    return g.select("p_partkey", "q1", "q3", F.round("iqr", 6).alias("iqr"))


@query("select p_partkey, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2 as r from part")
def egen_rank(spark, d):
    return WN.egen_rank(table(spark, d, "part"), "p_size", ["p_brand"], "r").select("p_partkey", "r")


@query("select p_partkey, dense_rank() over (order by p_brand, p_type) as g from part")
def egen_group(spark, d):
    return WN.group_id(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "g").select("p_partkey", "g")


@query("select p_partkey, case when row_number() over (partition by p_brand order by p_partkey) = 1 then 1.0 else 0.0 end as t from part")
def egen_tag(spark, d):
    return table(spark, d, "part").select("p_partkey", WN.tag(["p_brand"], ["p_partkey"]).alias("t"))


@query(f"select event_id, coalesce(v, 0) + value + user_id as rt, round((coalesce(v, 0) + value + user_id) / (case when v is null then 2 else 3 end), 6) as rm, least(v, value, cast(user_id as double)) as rlo, greatest(v, value, cast(user_id as double)) as rhi, case when v is null then 1.0 else 0.0 end as miss, case when v is null then 2.0 else 3.0 end as non from {GAPPY}")
def egen_row(spark, d):
    cs = ("v", "value", "user_id")
    g = lambda s: WN.row_stat(s, *cs)
    return gappy(spark, d).select("event_id", g("rowtotal").alias("rt"), F.round(g("rowmean"), 6).alias("rm"), g("rowmin").alias("rlo"), g("rowmax").alias("rhi"), g("rowmiss").alias("miss"), g("rownonmiss").alias("non"))


def _ts(k: int) -> str:
    return f"left join {USER_DAYS} l{abs(k)}{'m' if k < 0 else ''} on l{abs(k)}{'m' if k < 0 else ''}.user_id = u.user_id and l{abs(k)}{'m' if k < 0 else ''}.day = u.day - {k}"


@query(f"select u.user_id, u.day, l1.n as l1, l2.n as l2, l1m.n as f1 from {USER_DAYS} u {_ts(1)} {_ts(2)} {_ts(-1)}")
def ts_lag_lead(spark, d):
    p = WN.Panel("day", "user_id")
    n = F.col("n")
    return user_days(spark, d).select("user_id", "day", p.L(n).alias("l1"), p.L(n, 2).alias("l2"), p.F(n).alias("f1"))


@query(f"select u.user_id, u.day, u.n - l1.n as d1, u.n - 2 * l1.n + l2.n as d2, u.n - l2.n as s2 from {USER_DAYS} u {_ts(1)} {_ts(2)}")
def ts_diff(spark, d):
    p = WN.Panel("day", "user_id")
    n = F.col("n")
    return user_days(spark, d).select("user_id", "day", p.D(n).alias("d1"), p.D(n, 2).alias("d2"), p.S(n, 2).alias("s2"))


@query(f"select u.user_id, u.day, l1.n as \"L.n\", l2.n as \"L2.n\", l3.n as \"L3.n\" from {USER_DAYS} u {_ts(1)} {_ts(2)} {_ts(3)}")
def ts_operator_list(spark, d):
    p = WN.Panel("day", "user_id")
    return user_days(spark, d).select("user_id", "day", *[c.alias(n) for n, c in p.expand("L(1/3).n").items()])


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, round(sum(l_quantity), 2) as total, cast(count(l_quantity) as double) as n, max(l_quantity) as hi, min(l_quantity) as lo, round(stddev_samp(l_quantity), 6) as sd, quantile_cont(l_quantity, 0.5) as med, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr from lineitem group by 1")
def collapse_all_stats(spark, d):
    q = "l_quantity"
    x = A.collapse(table(spark, d, "lineitem"), {"mean": ("mean", q), "total": ("sum", q), "n": ("count", q), "hi": ("max", q), "lo": ("min", q), "sd": ("sd", q), "med": ("median", q), "p90": ("p90", "l_extendedprice"), "iqr": ("iqr", "l_extendedprice")}, ["l_returnflag"])
    return x.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 2), "sd": F.round("sd", 6), "p90": F.round("p90", 4), "iqr": F.round("iqr", 4)})


@query("select l_linestatus, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as mean, round(sum(l_quantity * l_discount), 4) as total, cast(count(*) as double) as n from lineitem where l_quantity > 0 group by 1")
def collapse_weighted(spark, d):
    x = A.collapse(table(spark, d, "lineitem"), {"mean": ("mean", "l_discount"), "total": ("sum", "l_discount"), "n": ("count", "l_discount")}, ["l_linestatus"], weight="l_quantity")
    return x.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query(f"select user_id, min_by(v, event_id) filter (where v is not null) as a, max_by(v, event_id) filter (where v is not null) as z from {GAPPY} group by 1")
def collapse_first_last(spark, d):
    return A.collapse(gappy(spark, d), {"a": ("first", "v"), "z": ("last", "v")}, ["user_id"], order=F.col("event_id"))


@query("select 'l_quantity' as variable, count(*) as n, round(avg(l_quantity), 4) as mean, round(stddev_samp(l_quantity), 4) as sd, min(l_quantity) as min, max(l_quantity) as max, round(sum(l_quantity), 4) as sum from lineitem union all select 'l_extendedprice', count(*), round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4), min(l_extendedprice), max(l_extendedprice), round(sum(l_extendedprice), 2) from lineitem")
def summarize_plain(spark, d):
    x = A.summarize(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(x).withColumn("sum", F.round("sum", 2))


@query("""with m as (select l_returnflag, count(*)::double as n, avg(l_extendedprice) as mu, stddev_samp(l_extendedprice) as sd from lineitem group by 1)
select l_returnflag, 'l_extendedprice' as variable, count(*) as n, round(any_value(mu), 4) as mean, round(any_value(sd), 4) as sd, round(avg(power(l_extendedprice - mu, 3)) / power(any_value(sd), 3), 6) as skewness, round(avg(power(l_extendedprice - mu, 4)) / power(any_value(sd), 4), 6) as kurtosis,
round(quantile_cont(l_extendedprice, 0.01), 4) as p1, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem join m using (l_returnflag) group by 1""")
def summarize_detail(spark, d):
    x = A.summarize(table(spark, d, "lineitem"), ["l_extendedprice"], by=["l_returnflag"], detail=True)
    return x.select("l_returnflag", "variable", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"), *[F.round(p, 4).alias(p) for p in ("p1", "p50", "p99")])


@query("with s as (select sum(l_quantity) as w, sum(l_quantity * l_discount) as wx, sum(l_quantity * l_discount * l_discount) as wxx from lineitem) select 'l_discount' as variable, cast(w as bigint) as n, round(wx / w, 6) as mean, round(sqrt((wxx - wx * wx / w) / (w - 1)), 6) as sd from s")
def summarize_fweight(spark, d):
    x = A.summarize(table(spark, d, "lineitem"), ["l_discount"], weight="l_quantity", kind="fweight")
    return x.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("select * from (select 'smallest' as side, row_number() over (order by c_acctbal) as rank, c_acctbal as value from customer) where rank <= 4 union all select * from (select 'largest', row_number() over (order by c_acctbal desc) as rank, c_acctbal from customer) where rank <= 4")
def summarize_extremes(spark, d):
    return A.extremes(table(spark, d, "customer"), "c_acctbal").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"select user_id, count(*) as n from {GAPPY} where v > 50 or v is null group by 1")
def count_if(spark, d):
    return A.count(gappy(spark, d), M.gt("v", 50), by=["user_id"])


@query("select c_mktsegment, count(*) as freq, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from customer group by 1")
def tabulate_freq(spark, d):
    x = A.tabulate(table(spark, d, "customer"), "c_mktsegment")
    return x.withColumn("percent", F.round(F.col("percent").cast("double"), 6))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as freq, round(sum(l_quantity) * 100.0 / sum(sum(l_quantity)) over (), 6) as percent from lineitem group by 1, 2")
def tabulate_two_way(spark, d):
    x = A.tabulate(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", weight="l_quantity")
    return x.withColumn("percent", F.round("percent", 6))


@query("select l_returnflag, grouping(l_returnflag)::int as is_total, round(avg(l_quantity), 6) as l_quantity_mean, round(stddev_samp(l_quantity), 6) as l_quantity_sd, cast(count(l_quantity) as double) as l_quantity_n, quantile_cont(l_quantity, 0.25) as l_quantity_p25, round(stddev_samp(l_quantity) / avg(l_quantity), 6) as l_quantity_cv from lineitem group by rollup (l_returnflag)")
def tabstat_by_total(spark, d):
    x = A.tabstat(table(spark, d, "lineitem"), ["l_quantity"], ["mean", "sd", "n", "p25", "cv"], by="l_returnflag")
    return rounded(x, 6)


@query(f"select 'v' as variable, 'numeric' as kind, count(*) as n, count(*) - count(v) as n_missing, count(distinct v) as n_distinct, min(v) as min, max(v) as max, round(avg(v), 6) as mean from {GAPPY} union all select 'event_type', 'string', count(*), 0, count(distinct event_type), null, null, null from events")
def codebook(spark, d):
    return A.codebook(gappy(spark, d), ["v", "event_type"]).withColumn("mean", F.round("mean", 6))


_MERGED = "select coalesce(o.o_custkey, c.c_custkey) as custkey, o.o_orderkey, c.c_mktsegment, case when o.o_orderkey is not null and c.c_custkey is not null then 3.0 when o.o_orderkey is not null then 1.0 else 2.0 end as _merge from (select o_orderkey, case when o_orderkey % 3 = 0 then -1000000000 - o_orderkey else o_custkey end as o_custkey from orders) o {} join (select c_mktsegment, case when c_custkey % 4 = 0 then -c_custkey else c_custkey end as c_custkey from customer) c on o.o_custkey = c.c_custkey"


def _sides(spark, d):
    """Every order and every customer; a third of the orders and a quarter of the customers get keys that the other side lacks."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    lost = F.when(F.col("o_orderkey") % 3 == 0, -1_000_000_000 - F.col("o_orderkey")).otherwise(F.col("o_custkey"))
    gone = F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return o.select(lost.alias("custkey"), "o_orderkey"), c.select(gone.alias("custkey"), "c_mktsegment", "c_acctbal")


@query(_MERGED.format("full outer"))
def merge_m1_full(spark, d):
    o, c = _sides(spark, d)
    return MG.merge(o, c, "m:1", ["custkey"], keepusing=["c_mktsegment"])


@query(_MERGED.format("inner"))
def merge_keep_match(spark, d):
    o, c = _sides(spark, d)
    return MG.merge(o, c, "m:1", ["custkey"], keep=["match"], keepusing=["c_mktsegment"])


@query(_MERGED.format("left"))
def merge_keep_master_match(spark, d):
    o, c = _sides(spark, d)
    return MG.merge(o, c, "m:1", ["custkey"], keep=["master", "match"], keepusing=["c_mktsegment"])


@query(_MERGED.format("left") + " where c.c_custkey is null")
def merge_keep_master(spark, d):
    o, c = _sides(spark, d)
    return MG.merge(o, c, "m:1", ["custkey"], keep=["master"], keepusing=["c_mktsegment"])


@query(_MERGED.format("right"))
def merge_1m(spark, d):
    o, c = _sides(spark, d)
    out = MG.merge(c.drop("c_acctbal"), o, "1:m", ["custkey"], keep=["master", "match"])
    return out.withColumn("_merge", F.when(F.col("_merge") == 1, 2.0).otherwise(F.col("_merge")))


@query("select a.c_custkey, coalesce(a.x, b.x) as x, coalesce(b.y, a.y) as y from (select c_custkey, case when c_custkey % 3 <> 0 then c_acctbal end as x, c_acctbal as y from customer) a left join (select c_custkey, c_acctbal * 2 as x, case when c_custkey % 5 = 0 then 0.0 end as y from (select * replace (case when c_custkey % 2 = 0 then c_custkey else -c_custkey end as c_custkey) from customer)) b using (c_custkey)")
def merge_update(spark, d):
    c = table(spark, d, "customer")
    a = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("x"), F.col("c_acctbal").alias("y"))
    k = F.col("c_custkey")
    b = c.withColumn("c_custkey", F.when(k % 2 == 0, k).otherwise(-k)).select("c_custkey", (F.col("c_acctbal") * 2).alias("x"), F.when(F.col("c_custkey") % 5 == 0, 0.0).alias("y"))
    one = MG.merge(a, b.select("c_custkey", "x"), "1:1", ["c_custkey"], keep=["master", "match"], update=True, generate=None)
    return MG.merge(one, b.select("c_custkey", "y"), "1:1", ["c_custkey"], keep=["master", "match"], replace=True, generate=None)


_WHOLE = "select coalesce(o.o_custkey, c.k) as custkey, o.o_orderkey, c.c_mktsegment, case when o.o_orderkey is not null and c.k is not null then 3.0 when o.o_orderkey is not null then 1.0 else 2.0 end as _merge from orders o {} join (select case when c_custkey % 4 = 0 then -c_custkey else c_custkey end as k, c_mktsegment from customer) c on o.o_custkey = c.k"


def _whole_sides(spark, d):
    """Every order and every customer; a quarter of the customers get a key that no order has."""
    key = F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return o, table(spark, d, "customer").select(key.alias("custkey"), "c_mktsegment")


@query(_WHOLE.format("full outer"))
def merge_whole_m1_full(spark, d):
    return MG.merge(*_whole_sides(spark, d), "m:1", ["custkey"])


@query(_WHOLE.format("inner"))
def merge_whole_keep_match(spark, d):
    return MG.merge(*_whole_sides(spark, d), "m:1", ["custkey"], keep=["match"])


@query(_WHOLE.format("left"))
def merge_whole_keep_master_match(spark, d):
    return MG.merge(*_whole_sides(spark, d), "m:1", ["custkey"], keep=["master", "match"])


@query(_WHOLE.format("left") + " where c.k is null")
def merge_whole_keep_master(spark, d):
    return MG.merge(*_whole_sides(spark, d), "m:1", ["custkey"], keep=["master"])


@query(_WHOLE.format("right"))
def merge_whole_1m(spark, d):
    o, c = _whole_sides(spark, d)
    out = MG.merge(c, o, "1:m", ["custkey"], keep=["master", "match"])
    return out.withColumn("_merge", F.when(F.col("_merge") == 1, 2.0).otherwise(F.col("_merge")))


@query("select coalesce(a.k, b.k) as k, coalesce(a.x, b.x) as x, coalesce(b.y, a.y) as y from (select c_custkey as k, case when c_custkey % 3 <> 0 then c_acctbal end as x, c_acctbal as y from customer) a full outer join (select case when c_custkey % 2 = 0 then c_custkey else -c_custkey end as k, c_acctbal * 2 as x, case when c_custkey % 5 = 0 then 0.0 end as y from customer) b using (k)")
def merge_whole_update(spark, d):
    """Every customer on both sides, half of the second under keys of their own."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    a = c.select(k.alias("k"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("x"), F.col("c_acctbal").alias("y"))
    b = c.select(F.when(k % 2 == 0, k).otherwise(-k).alias("k"), (F.col("c_acctbal") * 2).alias("x"), F.when(k % 5 == 0, 0.0).alias("y"))
    one = MG.merge(a, b.select("k", "x"), "1:1", ["k"], update=True, generate=None)
    return MG.merge(one, b.select("k", "y"), "1:1", ["k"], replace=True, generate=None)


@query("select o_orderkey, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def merge_chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    x = MG.merge(o, table(spark, d, "customer"), "m:1", ["c_custkey"], keep=["match"], keepusing=["c_nationkey"], generate=None)
    x = MG.merge(x.withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), "m:1", ["n_nationkey"], keep=["match"], generate=None)
    x = MG.merge(x.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), "m:1", ["r_regionkey"], keep=["match"], generate=None)
    return x.select("o_orderkey", "n_name", "r_name")


@query("select copies, sum(copies)::bigint as n_rows, sum(copies - 1)::bigint as surplus from (select count(*) as copies from lineitem group by l_orderkey, l_linenumber) group by 1")
def duplicates_report(spark, d):
    return A.duplicates_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select doc_id, case_no, version_no from (select *, row_number() over (partition by case_no, version_no order by doc_id) as rn from documents) where rn = 1")
def duplicates_drop(spark, d):
    return A.duplicates_drop(table(spark, d, "documents").select("doc_id", "case_no", "version_no"), ["case_no", "version_no"], ["doc_id"])


@query("select count(*) as n from orders")
def isid_check(spark, d):
    return A.count(A.isid(table(spark, d, "orders"), ["o_orderkey"]))


_YEARS = range(1995, 2002)
_STATUS_YEAR = "(select o_orderstatus, year(o_orderdate) as yr, round(sum(o_totalprice), 2) as price, cast(count(*) as double) as cnt from orders group by 1, 2)"
_WIDE = f"(select o_orderstatus, {', '.join(f'max(case when yr = {y} then {c} end) as {c}{y}' for y in _YEARS for c in ('price', 'cnt'))} from {_STATUS_YEAR} group by 1)"


def _status_year(spark, d):
    o = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    x = A.collapse(o, {"price": ("sum", "o_totalprice"), "cnt": ("count", "o_totalprice")}, ["o_orderstatus", "yr"])
    return x.withColumn("price", F.round("price", 2))


@query(f"select * from {_WIDE}")
def reshape_wide(spark, d):
    return R.wide(_status_year(spark, d), ["price", "cnt"], ["o_orderstatus"], "yr")


@query(f"select o_orderstatus, y as yr, price, cnt from ({' union all '.join(f'select o_orderstatus, {y} as y, price{y} as price, cnt{y} as cnt from {_WIDE}' for y in _YEARS)})")
def reshape_long(spark, d):
    return R.long(R.wide(_status_year(spark, d), ["price", "cnt"], ["o_orderstatus"], "yr"), ["price", "cnt"], ["o_orderstatus"], "yr")


_CUST_YEAR = "(select o_custkey, year(o_orderdate) as yr, round(sum(o_totalprice), 2) as price, cast(count(*) as double) as cnt from orders group by 1, 2)"
_CUST_WIDE = f"(select o_custkey, {', '.join(f'max(case when yr = {y} then {c} end) as {c}{y}' for y in _YEARS for c in ('price', 'cnt'))} from {_CUST_YEAR} group by 1)"


def _customer_year(spark, d):
    o = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    x = A.collapse(o, {"price": ("sum", "o_totalprice"), "cnt": ("count", "o_totalprice")}, ["o_custkey", "yr"])
    return x.withColumn("price", F.round("price", 2))


@query(f"select * from {_CUST_WIDE}")
def reshape_wide_customers(spark, d):
    """One row per customer from all orders of all years; grows with the table."""
    return R.wide(_customer_year(spark, d), ["price", "cnt"], ["o_custkey"], "yr")


@query(f"select o_custkey, y as yr, price, cnt from ({' union all '.join(f'select o_custkey, {y} as y, price{y} as price, cnt{y} as cnt from {_CUST_WIDE}' for y in _YEARS)})")
def reshape_long_customers(spark, d):
    return R.long(reshape_wide_customers(spark, d), ["price", "cnt"], ["o_custkey"], "yr")


@query("select p_partkey, case when p_size between 1 and 10 then 1.0 when p_size in (11, 15) then 2.0 when p_size > 40 then 3.0 else cast(p_size as double) end as grp, case when p_retailprice < 1000 then 0.0 else 9.0 end as cls from part")
def recode_ranges(spark, d):
    x = P.recode(table(spark, d, "part"), ["p_size"], [((1, 10), 1), ([11, 15], 2), ((41, None), 3)], ["grp"])
    return P.recode(x, ["p_retailprice"], [((None, 999.999999), 0), ("else", 9)], ["cls"]).select("p_partkey", "grp", "cls")


@query("select c_custkey, cast(dense_rank() over (order by c_mktsegment) as double) as code, c_mktsegment as txt from customer")
def encode_decode(spark, d):
    x, _ = P.encode(table(spark, d, "customer"), "c_mktsegment", "code")
    return P.decode(x, "code", "txt").select("c_custkey", "code", "txt")


@query("select p_partkey, try_cast(replace(replace(p_brand, 'Brand', ''), '#', '') as double) as no, try_cast(p_type as double) as bad, cast(p_size as varchar) as txt from part")
def destring_tostring(spark, d):
    x = P.destring(table(spark, d, "part"), ["p_brand"], ["no"], ignore="Brand#")
    x = P.destring(x, ["p_type"], ["bad"], force=True)
    return P.tostring(x, ["p_size"], ["txt"]).select("p_partkey", "no", "bad", "txt")


@query("select p_partkey as part_id, p_brand as x_brand, p_type as x_type from part")
def rename_order(spark, d):
    x = P.keep(table(spark, d, "part"), "p_partkey p_brand-p_type")
    return P.order(P.rename(P.rename(x, "p_partkey", "part_id"), "p_*", "x_*"), "part_id")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def sort_topk(spark, d):
    return WN.in_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1, 100, "-o_totalprice", "o_orderkey")


@query(f"select event_id, row_number() over (order by v desc nulls first, event_id) as pos from {GAPPY}")
def gsort_desc_missing(spark, d):
    return WN.numbered(gappy(spark, d).select("event_id", "v"), "-v", "event_id", name="pos").select("event_id", "pos")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as n from orders) where n between 501 and 900")
def list_in_range(spark, d):
    return WN.in_range(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 501, 900, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("select 'l_extendedprice' as var1, 'l_quantity' as var2, round(corr(l_extendedprice, l_quantity), 6) as rho, count(*) as n from lineitem union all select 'l_discount', 'l_quantity', round(corr(l_discount, l_quantity), 6), count(*) from lineitem union all select 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6), count(*) from lineitem")
def pwcorr_pairs(spark, d):
    return A.pwcorr(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("rho", F.round("rho", 6))


@query(f"with p as (select user_id, count(*) as t, min(day) as lo, max(day) as hi from {USER_DAYS} group by 1) select count(*) as n_panels, sum(t)::bigint as n_obs, min(lo) as first_t, max(hi) as last_t, min(t) as t_min, quantile_cont(t, 0.05) as t_p5, quantile_cont(t, 0.25) as t_p25, quantile_cont(t, 0.5) as t_p50, quantile_cont(t, 0.75) as t_p75, quantile_cont(t, 0.95) as t_p95, max(t) as t_max, avg(t) as t_mean, (min(t) = max(t))::int as balanced from p")
def xtdescribe(spark, d):
    return A.xtdescribe(user_days(spark, d), "user_id", "day")


@query("with s as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem) select cast(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as freq from lineitem, s group by 1")
def histogram_bins(spark, d):
    return A.histogram_bins(table(spark, d, "lineitem"), "l_quantity", 20).select("bin", "freq")


@query("""with r as (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice) as i, count(*) over (partition by l_returnflag) as n from lineitem),
q as (select l_returnflag, any_value(n) as n, """ + ", ".join(f"max(case when i = greatest(1, least(n, floor((n + 1) * {p}))) then x end) + (max((n + 1) * {p}) - max(floor((n + 1) * {p}))) * (max(case when i = least(n, floor((n + 1) * {p}) + 1) then x end) - max(case when i = greatest(1, least(n, floor((n + 1) * {p}))) then x end)) as {a}" for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + """ from r group by 1)
select q.l_returnflag, any_value(q.n) as n, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3, min(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as lower_adjacent, max(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as upper_adjacent, count(*) filter (where x not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outside from r join q using (l_returnflag) group by 1""")
def box_stats(spark, d):
    x = A.box_stats(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return x.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("""select event_id, round(sin(value), 6) as s, round(cos(value), 6) as c, round(tan(value / 100), 6) as t, round(sinh(value / 50), 6) as sh, round(cosh(value / 50), 6) as ch, round(tanh(value / 50), 6) as th,
round(atan(value), 6) as at, round(atan2(value - 50, value), 6) as at2, round(case when abs(value / 50 - 1) <= 1 then asin(value / 50 - 1) end, 6) as asn, round(case when abs(value / 50 - 1) <= 1 then acos(value / 50 - 1) end, 6) as acs, round(case when value > 50 then log10(value - 50) end, 6) as lg,
round(value) as r1, round(value / 0.25) * 0.25 as r4 from events""")
def trig_funcs(spark, d):
    x = table(spark, d, "events")
    v, u = F.col("value"), F.col("value") / 50 - 1
    six = {"s": N.sin(v), "c": N.cos(v), "t": N.tan(v / 100), "sh": N.sinh(v / 50), "ch": N.cosh(v / 50), "th": N.tanh(v / 50), "at": N.atan(v), "at2": N.atan2(v - 50, v), "asn": N.asin(u), "acs": N.acos(u), "lg": N.log10(v - 50)}
    return x.select("event_id", *[F.round(c, 6).alias(n) for n, c in six.items()], N.round_to(v).alias("r1"), N.round_to(v, 0.25).alias("r4"))


@query(r"""select p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_type || '-' || p_name), '[^ -]*[ -]?'), lambda w: upper(w[1]) || w[2:]), '') as pr, ltrim(p_name || ' ', ' ') as lt, rtrim('  ' || p_name || '  ', ' ') as rt,
regexp_replace(p_type || '   x  ' || p_name, ' +', ' ', 'g') as it, case when contains(p_name, 'a') then length(p_name) - instr(reverse(p_name), 'a') + 1 else 0 end as rp, regexp_replace(p_name, '(^|[^A-Za-z0-9_])' || string_split(p_name, ' ')[1] || '($|[^A-Za-z0-9_])', '\1\2', 'g') = p_name as whole,
chr(65 + cast(p_size % 26 as int)) as ch, cast(p_retailprice as double) as num, printf('%9.2f', p_retailprice) as f2, printf('%.3e', p_retailprice) as e3, printf('%8.4g', p_retailprice) as g4, printf('%-8.1fx', p_retailprice) as lf, printf('%.0f', cast(p_size as double)) as plain,
replace(' ' || p_type || ' ', ' ' || p_type || ' ', ' # ') as sw from part""")
def string_more(spark, d):
    x = table(spark, d, "part")
    first = S.word("p_name", 1)
    whole = F.regexp_replace("p_name", F.concat(F.lit("(^|[^A-Za-z0-9_])"), first, F.lit("($|[^A-Za-z0-9_])")), F.lit("$1$2")) == F.col("p_name")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return x.select(
        "p_partkey", S.proper(F.concat("p_type", F.lit("-"), "p_name")).alias("pr"), S.ltrim(F.concat("p_name", F.lit(" "))).alias("lt"), S.rtrim(F.concat(F.lit("  "), "p_name", F.lit("  "))).alias("rt"),
        S.itrim(F.concat("p_type", F.lit("   x  "), "p_name")).alias("it"), S.strrpos("p_name", "a").alias("rp"), whole.alias("whole"), S.char(65 + F.col("p_size") % 26).alias("ch"), S.real(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).alias("num"),
        S.strofreal("p_retailprice", "%9.2f").alias("f2"), S.strofreal("p_retailprice", "%.3e").alias("e3"), S.strofreal("p_retailprice", "%8.4g").alias("g4"), F.concat(S.strofreal("p_retailprice", "%-8.1f"), F.lit("x")).alias("lf"), S.string("p_size").alias("plain"),
        F.replace(pad(F.col("p_type")), pad(F.col("p_type")), F.lit(" # ")).alias("sw"),
    )


@query(r"select doc_id, regexp_replace(text, '\bder\b', 'DER', 'g') as t from (select doc_id, regexp_replace(replace(text, e'\n', ' '), '[^A-Za-z0-9_ .,]', '', 'g') as text from documents)")
def string_subinword(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), "[^A-Za-z0-9_ .,]", "").alias("text"))
    return x.select("doc_id", F.when(F.col("text").isNotNull(), S.subinword("text", "der", "DER")).alias("t"))


_Y, _M, _DD = f"year({_DAY})", f"month({_DAY})", f"day({_DAY})"
_SINCE = "cast(date_diff('day', date '1960-01-01', {}) as double)"
_HALF = f"(case when {_M} <= 6 then 1 else 2 end)"
_WEEK = f"least((dayofyear({_DAY}) - 1) // 7 + 1, 52)"


@query(f"""select o_orderkey, cast(({_Y} - 1960) * 12 + {_M} - 1 as double) as ym, cast(({_Y} - 1960) * 4 + quarter({_DAY}) - 1 as double) as yq, cast(({_Y} - 1960) * 2 + {_HALF} - 1 as double) as yh, cast(({_Y} - 1960) * 52 + {_WEEK} - 1 as double) as yw,
cast({_HALF} as double) as half, cast(({_Y} - 1960) * 2 + {_HALF} - 1 as double) as hofd, cast(({_Y} - 1960) * 52 + {_WEEK} - 1 as double) as wofd, {_SINCE.format(f"make_date({_Y}, case when {_M} <= 6 then 1 else 7 end, 1)")} as dofh, {_SINCE.format(f"make_date({_Y}, 1, 1)")} as dofy, cast({_Y} as double) as yofd,
cast(({_Y} - 1960) * 12 + {_M} - 1 as double) as monthly, cast(({_Y} - 1960) * 2 + {_HALF} - 1 as double) as halfyearly, cast(({_Y} - 1960) * 52 + {_WEEK} - 1 as double) as weekly, cast({_Y} as double) as yearly, {_SINCE.format(_DAY)} as daily, {_SINCE.format(_DAY)} as daily_name,
{_SINCE.format(_DAY)} >= {_SINCE.format("date '1997-03-05'")} as since_day, ({_Y} - 1960) * 12 + {_M} - 1 < (1997 - 1960) * 12 + 2 as before_month, ({_Y} - 1960) * 4 + quarter({_DAY}) - 1 = (1997 - 1960) * 4 + 1 as in_quarter from orders""")
def date_more(spark, d):
    x = table(spark, d, "orders").withColumn("t", D.days("o_orderdate"))
    y, m, q = D.year("t"), D.month("t"), D.quarter("t")
    text = lambda sep, c: F.concat_ws(sep, y.cast("int").cast("string"), c.cast("int").cast("string"))
    day = F.col("o_orderdate").cast("date")
    return x.select(
        "o_orderkey", D.ym(y, m).alias("ym"), D.yq(y, q).alias("yq"), D.yh(y, D.halfyear("t")).alias("yh"), D.yw(y, D.week("t")).alias("yw"), D.halfyear("t").alias("half"), D.hofd("t").alias("hofd"), D.wofd("t").alias("wofd"), D.dofh(D.hofd("t")).alias("dofh"), D.dofy(y).alias("dofy"), D.yofd("t").alias("yofd"),
        D.monthly(text("m", m)).alias("monthly"), D.halfyearly(text("-H", D.halfyear("t"))).alias("halfyearly"), D.weekly(text("w", D.week("t"))).alias("weekly"), D.yearly(y.cast("int").cast("string")).alias("yearly"), D.daily(F.date_format(day, "d/M/yyyy"), "DMY").alias("daily"), D.daily(F.date_format(day, "dMMMyyyy"), "DMY").alias("daily_name"),
        (F.col("t") >= D.td("5mar1997")).alias("since_day"), (D.mofd("t") < D.tm("1997m3")).alias("before_month"), (D.qofd("t") == D.tq("1997q2")).alias("in_quarter"),
    )


_PHI = "(0.5 + sign({0}) * exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: case when abs({0}) > 0 then exp((2 * k + 1) * ln(abs({0})) - (lgamma(2.0 * k + 2) - k * ln(2.0) - lgamma(k + 1.0))) else 0 end)))"


@query(f"""select c_custkey, round({_PHI.format("z")}, 8) as p, round(ln({_PHI.format("z")}), 7) as lp, round(z, 7) as z, round(0.5 - 0.5 * z / sqrt(10 + z * z) * (1 + 0.5 * c + 0.375 * c * c + 0.3125 * c * c * c + 0.2734375 * c * c * c * c), 8) as t, round(pow(1 - exp(-abs(z) / 2), 1), 8) as x2, round(exp(-abs(z) / 2) * (1 + abs(z) / 2), 8) as x4,
round(pow(1 + 2 * abs(z) / 9, -4.5), 8) as f, round(1 - pow(1 + 2 * abs(z) / 9, -4.5), 8) as fc, round((1 - 2 * q) / sqrt(2 * q * (1 - q)), 6) as it from (select *, c_acctbal / 5000 as z, 10 / (10 + c_acctbal / 5000 * c_acctbal / 5000) as c, (c_custkey % 97 + 1) / 100.0 as q from customer)""")
def distribution_closed(spark, d):
    """The distributions at arguments for which they have closed forms or a plain series."""
    z = F.col("c_acctbal") / 5000
    two, nine = F.lit(2.0), F.lit(9.0)
    e = lambda c, n, k=8: F.round(c, k).alias(n)
    return table(spark, d, "customer").select(
        "c_custkey", e(N.normal(z), "p"), e(N.lnnormal(z), "lp", 7), e(N.invnormal(N.normal(z)), "z", 7), e(N.ttail(F.lit(10.0), z), "t"), e(N.chi2(two, F.abs(z)), "x2"), e(N.chi2tail(F.lit(4.0), F.abs(z)), "x4"), e(N.ftail(two, nine, F.abs(z)), "f"), e(N.fcdf(two, nine, F.abs(z)), "fc"),
        e(N.invttail(two, (F.col("c_custkey") % 97 + 1) / 100.0), "it", 6),
    )


_COPIES = "(select l_returnflag, l_extendedprice as x from lineitem, range(cast(l_quantity as bigint)))"


@query(f"""select l_returnflag, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as sd, round(quantile_cont(x, 0.5), 4) as med, round(quantile_cont(x, 0.9), 4) as p90, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) as iqr from {_COPIES} group by 1""")
def collapse_weighted_percentiles(spark, d):
    """A weight counts a row so many times, in percentiles too."""
    x = "l_extendedprice"
    return rounded(A.collapse(table(spark, d, "lineitem"), {"mean": ("mean", x), "sd": ("sd", x), "med": ("median", x), "p90": ("p90", x), "iqr": ("iqr", x)}, ["l_returnflag"], weight="l_quantity"))


@query(f"""with m as (select l_returnflag, avg(x) as mu, stddev_samp(x) as sd from {_COPIES} group by 1)
select l_returnflag, 'l_extendedprice' as variable, count(*) as n, round(any_value(sd * sd), 2) as variance, round(avg(power(x - mu, 3)) / power(any_value(sd), 3), 5) as skewness, round(avg(power(x - mu, 4)) / power(any_value(sd), 4), 5) as kurtosis, round(quantile_cont(x, 0.05), 4) as p5, round(quantile_cont(x, 0.5), 4) as p50 from {_COPIES} join m using (l_returnflag) group by 1""")
def summarize_weighted_detail(spark, d):
    x = A.summarize(table(spark, d, "lineitem"), ["l_extendedprice"], by=["l_returnflag"], weight="l_quantity", kind="fweight", detail=True)
    return x.select("l_returnflag", "variable", "n", F.round("variance", 2).alias("variance"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), F.round("p5", 4).alias("p5"), F.round("p50", 4).alias("p50"))


@query(f"select u.user_id, u.day, l1.n as \"L.n\", l1.x as \"L.x\", l1.n - l2.n as \"LD.n\", l2.n - l3.n as \"L2D.n\" from {USER_DAYS} u {_ts(1)} {_ts(2)} {_ts(3)}")
def ts_operator_chain(spark, d):
    """Lists over several variables and every combination of a chain of operators."""
    p = WN.Panel("day", "user_id")
    cols = p.expand("L.(n x)") | p.expand("L(1/2)D.n")
    return user_days(spark, d).select("user_id", "day", *[c.alias(n) for n, c in cols.items()]).withColumn("L.x", F.col("`L.x`"))


def _written(spark: SparkSession, df: DataFrame, ext: str) -> str:
    path = f"{shared_folder(spark)}/{uuid.uuid4()}.{ext}"
    files.save(df, path)
    return path


@query("select cast(p_partkey as double) as p_partkey, p_name || ', \"' || p_brand || '\"' as label, p_retailprice as price from part")
def delimited_round_trip(spark, d):
    """Every part written as comma-separated text, with quotes and commas in its cells, and read back."""
    x = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), F.col("p_retailprice").alias("price"))
    return files.use(spark, _written(spark, x, "csv"))


@query("select doc_id, coalesce(text, '') as text from documents")
def multiline_round_trip(spark, d):
    """Every text with its line breaks written as tab-separated text and read back."""
    x = table(spark, d, "documents").select("doc_id", "text")
    return files.use(spark, _written(spark, x, "tsv")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 100000")
def formats_round_trip(spark, d):
    """Orders through ORC and JSON, columns and filter given to the reader."""
    x = files.use(spark, _written(spark, table(spark, d, "orders"), "orc"), ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return files.use(spark, _written(spark, x, "json"), ["o_orderkey", "o_orderstatus", "o_totalprice"], "o_totalprice > 100000")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_hourly(spark, d):
    """The batch form of the tumbling window that ``tabulon.streaming`` keeps over a stream."""
    from tabulon.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


from tabulon.plans import models  # noqa: E402  (registers its queries here)

QUERIES |= models.QUERIES
ORACLE |= models.ORACLE
