"""Queries of the training-data problems 1 to 6, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import eav, impute, references, regrid, reject, schema_drift
from tabulon.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.found(table(spark, d, "weo_files"), table(spark, d, "weo_lines"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "weo_files"), table(spark, d, "weo_lines"))


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every rename, cast and default that takes a file to the consistent table."""
    return schema_drift.migration_steps(table(spark, d, "weo_files"), table(spark, d, "weo_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.found(table(spark, d, "panel"), table(spark, d, "regions"), table(spark, d, "grunfeld"))


def p2_panel(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill_panel(table(spark, d, "panel"), table(spark, d, "regions"))


def p2_grunfeld(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill_grunfeld(table(spark, d, "grunfeld"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reject.rejected(table(spark, d, "raw_records")).select("file_id", "line_no", "reason")


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records per reason and first broken field."""
    return reject.rejected(table(spark, d, "raw_records")).groupBy("reason", "field").agg(F.count("*").alias("n_rows"))


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return reject.valid(table(spark, d, "raw_records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.all_orphans(table(spark, d, "panel"), table(spark, d, "regions"), table(spark, d, "country_ref"), table(spark, d, "region_ref"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "fld", "row_id", "kind")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.counts(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.found(table(spark, d, "weo_obs"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per vintage, iso and yr, a typed column per code."""
    return eav.wide(table(spark, d, "weo_obs"))[0].drop("obs_ids")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    air = regrid.airline_grid(table(spark, d, "airline")).withColumn("tbl", F.lit("airline"))
    pan = regrid.panel_grid(table(spark, d, "panel"), table(spark, d, "regions")).withColumn("tbl", F.lit("panel"))
    return air.unionByName(pan).filter("is_filled").select("tbl", F.col("source").alias("src_key"), "period")


def _rounded(grid: DataFrame) -> DataFrame:
    return grid.withColumn("value", F.round("value", 4)).withColumn("coverage", F.round("coverage", 6))


def p6_airline(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(regrid.airline_grid(table(spark, d, "airline")))


def p6_panel(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(regrid.panel_grid(table(spark, d, "panel"), table(spark, d, "regions")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_table, p1_steps, p2_found, p2_panel, p2_grunfeld, p3_found, p3_fields, p3_valid, p4_found, p4_counts, p5_found, p5_wide, p6_found, p6_airline, p6_panel)}

_K = r"nullif(upper(regexp_replace({0}, '^[ \t]+|[ \t]+$', '', 'g')), '')"
_NUM = "coalesce({0} > 0 and {0} < 1e12, false)"
_CUR = "coalesce(regexp_full_match(currency, '[A-Z]{3}'), false)"


def _k(c: str) -> str:
    return _K.format(c)


def _marks() -> str:
    parts = []
    for fld, ok in (("gdp", _NUM.format("gdp")), ("pop", _NUM.format("pop")), ("currency", _CUR)):
        parts.append(f"select 'panel' as tbl, row_id, '{fld}' as fld from (select row_id, {ok} as ok, bool_or({ok}) over (partition by k) as has from p) where not ok and has")
    ok = _NUM.format("invest")
    parts.append(f"select 'grunfeld' as tbl, row_id, 'invest' as fld from (select row_id, {ok} as ok, bool_or({ok}) over (partition by firm) as has from grunfeld where firm is not null) where not ok and has")
    return f"with known as (select distinct {_k('country')} as k from regions), p as (select row_id, gdp, pop, currency, {_k('country')} as k from panel where {_k('country')} in (select k from known where k is not null)) " + " union all ".join(parts)


def _orphan_sql(child: str, fld: str, at: str, parent: str, key: str) -> str:
    return (
        f"select '{child}' as tbl, '{fld}' as fld, c.row_id, c.ref_at, case when c.n = 0 then 'missing' when c.first_born > c.ref_at then 'late' else 'deleted' end as kind from "
        f"(select c.row_id, c.{at} as ref_at, count(p.created_at) as n, min(p.created_at) as first_born, count(*) filter (where p.created_at <= c.{at} and (p.deleted_at is null or c.{at} < p.deleted_at)) as alive "
        f"from {child} c left join {parent} p on {_k('c.' + fld)} = {_k('p.' + key)} where {_k('c.' + fld)} is not null group by 1, 2) c where c.alive = 0"
    )


_ORPHANS = " union all ".join([_orphan_sql("panel", "country", "loaded_at", "regions", "country"), _orphan_sql("regions", "country", "created_at", "country_ref", "country"), _orphan_sql("regions", "region", "created_at", "region_ref", "region")])

_OBS = r"""with o as (select vintage, yr, obs_id, loaded_at, upper(trim(val, e' \t')) as u, trim(val, e' \t') as v,
 case when series_code is not null then split_part(s, '.', 1) else upper(regexp_replace(iso, '\s', '', 'g')) end as iso,
 case when series_code is not null then split_part(s, '.', 2) else upper(regexp_replace(weo_subject_code, '\s', '', 'g')) end as subject_code
 from (select *, upper(regexp_replace(series_code, '\s', '', 'g')) as s from weo_obs) where series_code is null or split_part(s, '.', 3) = 'A'),
r as (select *, row_number() over (partition by vintage, iso, yr, subject_code order by loaded_at desc, obs_id) as rn from o where iso <> '' and subject_code <> ''),
w as (select *, case when u is null or u in ('', 'N/A', '--', '-', 'NA') then false when subject_code in ('BASE_NOTE', 'METHOD') then true
 when subject_code = 'REV_DATE' then regexp_full_match(v, '\d{4}-\d{2}-\d{2}') when subject_code = 'EST_AFTER' then regexp_full_match(v, '[+-]?\d{1,9}')
 else regexp_full_match(v, '[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?') end as ok from r where rn = 1) """

_HOLES = f"""with known as (select distinct {_k('country')} as k from regions),
a as (select distinct 'airline' as tbl, {_k('carrier')} as src_key, cast(year * 12 + month - 1 as bigint) as p from airline
 where passengers > 0 and not isnan(passengers) and month = floor(month) and month between 1 and 12 and year = floor(year) and not isnan(year)),
b as (select distinct 'panel' as tbl, {_k('country')} as src_key, cast(year as bigint) as p from panel where year is not null and not isnan(year) and {_k('country')} in (select k from known where k is not null)),
u as (select * from a union all select * from b),
g as (select tbl, src_key, p, lead(p) over (partition by tbl, src_key order by p) as nxt from u where src_key is not null)
select tbl, src_key, case when tbl = 'airline' then cast(q // 12 * 100 + q % 12 + 1 as bigint) else q end as period from (select tbl, src_key, unnest(range(p + 1, nxt)) as q from g where nxt > p + 1)"""

_D = {"\t": "\\t", ";": ";", "|": "|", ",": ","}
_FREE = {d: rf'(?:"(?:[^"]|"")*"|[^"{x}\r\n]*)' for d, x in _D.items()}


def _per_delimiter(form: str) -> str:
    return "case d " + " ".join(f"when e'{x}' then " + form.format(cell=_FREE[d], d=x) for d, x in _D.items()) + " end"


def _cell(name: str) -> str:
    return f"cells[list_position(names, '{name}')]"


_NUMERIC = r"^[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_VALID = {
    "country": f"{_cell('country')} not in ('NA', 'n/a') and regexp_matches({_cell('country')}, '\\p{{L}}') and not regexp_matches(replace(replace({_cell('country')}, e'\\n', ''), e'\\r', ''), '[\\p{{Cc}}\\x{{FFFD}}]')",
    "year": f"regexp_matches({_cell('year')}, '^(19\\d\\d|20\\d\\d|2100)$')",
    "firm": f"regexp_matches({_cell('firm')}, '^0*[1-9]\\d*$')",
    **{c: f"({_cell(c)} in ('', '.', 'n/a', 'NA', '--', '-') or regexp_matches({_cell(c)}, '{_NUMERIC}'))" for c in ("gdp", "pop", "invest", "value", "capital")},
}
_REJECTED = f"""with h as (select file_id, regexp_replace(raw_line, '[\\x{{FEFF}}\\r\\n]', '', 'g') as h from raw_records where line_no = 1),
s as (select *, case when contains(h, e'\\t') then e'\\t' when contains(h, ';') then ';' when contains(h, '|') then '|' else ',' end as d from h),
k as (select *, list_sort(names) as sorted from (select file_id, d, list_transform(string_split(h, d), lambda x: trim(x, e' \\t"')) as names from s)),
f as (select file_id, d, names, case when sorted = ['country', 'gdp', 'pop', 'year'] then 'panel' else 'grunfeld' end as kind from k where sorted in (['country', 'gdp', 'pop', 'year'], ['capital', 'firm', 'invest', 'value', 'year'])),
r as (select r.file_id, r.line_no, f.d, f.names, f.kind, regexp_replace(coalesce(raw_line, ''), '\\r$', '') as l from raw_records r left join f using (file_id) where r.line_no > 1),
c as (select *, {_per_delimiter("regexp_full_match(l, '{cell}(?:[{d}]{cell})*')")} as sound, {_per_delimiter("regexp_extract_all(e'{d}' || l, '[{d}]({cell})', 1)")} as raw from r),
v as (select *, list_transform(raw, lambda x: trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end, e' \\t')) as cells from c),
j as (select file_id, line_no, case when kind is null then 'column_count' when not sound then 'quoting' when len(cells) <> len(names) then 'column_count'
 when kind = 'panel' and not ({" and ".join(_VALID[c] for c in ("country", "year", "gdp", "pop"))}) then 'bad_value'
 when kind = 'grunfeld' and not ({" and ".join(_VALID[c] for c in ("firm", "year", "invest", "value", "capital"))}) then 'bad_value' end as reason from v)
select file_id, line_no, reason from j where reason is not null"""

# Step functions by brute force: every pair of a reading and the next one of its source, cut by the grid cells it reaches.
_STEPS = """, l as (select *, lead(p + frac) over w as nxt from r window w as (partition by source order by p, frac, tie)),
iv as (select source, value, p + frac as a, least(coalesce(nxt, p + frac + 1), p + frac + 1) as b from l),
span as (select source, min(p) as lo, max(p) as hi from r group by 1),
g as (select source, unnest(range(lo, hi + 1)) as q from span),
cells as (select g.source, g.q, sum(least(b, q + 1) - greatest(a, q)) as cov, sum(value * (least(b, q + 1) - greatest(a, q))) as area, count(*) as pieces from g join iv on iv.source = g.source and iv.value is not null and iv.b > g.q and iv.a < g.q + 1 group by 1, 2),
own as (select source, p, count(*) as n, avg(value) as mean, last(value order by frac, tie) as held from r group by 1, 2)
select g.source as source, {period} as period, coalesce(own.n, 0) as n_readings, round(case when own.n is null then before.held else coalesce(case when cov > 0 then area / cov end, own.mean) end, 4) as value, round(coalesce(cov, 0), 6) as coverage, own.n is null as is_filled
from g left join cells using (source, q) left join own on own.source = g.source and own.p = g.q asof left join own before on before.source = g.source and before.p <= g.q"""

_AIRLINE = f"""with r as (select source, p, value, tie, greatest(0.0, least(0.999, coalesce((epoch_us(read_at) - epoch_us(make_timestamp(y, m, 1, 0, 0, 0.0))) / (86400000000.0 * date_diff('day', make_date(y, m, 1), make_date(y, m, 1) + interval 1 month)), 0.0))) as frac
 from (select {_k('carrier')} as source, cast(year as bigint) * 12 + cast(month as bigint) - 1 as p, cast(year as bigint) as y, cast(month as bigint) as m, passengers as value, row_id as tie, read_at from airline
 where passengers > 0 and not isnan(passengers) and month = floor(month) and month between 1 and 12 and year = floor(year) and not isnan(year) and year between 1 and 9999) where source is not null)""" + _STEPS.format(period="cast(g.q // 12 * 100 + g.q % 12 + 1 as bigint)")

_TERRITORIES = f"""with known as (select distinct {_k('country')} as k from regions),
r as (select {_k('country')} as source, cast(year as bigint) as p, 0.0 as frac, row(loaded_at, row_id) as tie, case when gdp > 0 and gdp < 1e12 then gdp end as value from panel
 where year = floor(year) and not isnan(year) and year between 1 and 9999 and {_k('country')} in (select k from known where k is not null))""" + _STEPS.format(period="g.q")

ORACLE: dict[str, str] = {
    "p6_airline": _AIRLINE,
    "p6_panel": _TERRITORIES,
    "p3_found": _REJECTED,
    "p2_found": _marks(),
    "p4_found": f"select tbl, fld, row_id, kind from ({_ORPHANS})",
    "p4_counts": f"select tbl, fld, kind, strftime(ref_at, '%Y-%m') as period, count(*) as n_rows from ({_ORPHANS}) group by 1, 2, 3, 4",
    "p5_found": _OBS + "select vintage, iso, yr, subject_code, obs_id from w where ok",
    "p6_found": _HOLES,
}
