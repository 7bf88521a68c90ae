"""Schemas that drift between files (problem 1).

Every file gets a fingerprint of its (field, type) list, and a feed a new version wherever the
fingerprint differs from that of the delivery before. Only there are the two compared; the
differences become recorded migration steps (rename, default, cast). ``registry`` is the table
of them: the list of changes is read from it, and its renames are chained back to the first
delivery, so that every file is routed into one consistent table.

A line is split at delimiters into raw cells; types are judged per (file, position), and only
the cells of changed fields are read again to tell renames from additions. Headers and wanted
positions, one short row per file, are broadcast below a counted bound, so lines stay where
they are read.

Defined results for odd input: null or empty lines give no cells; a header without a name
at a position drops that cell; repeated names in one header are one field, typed over all
its cells, which gives its first filled cell;
repeated series in one file compare by their smallest value; a file without data rows has
fields of no type, which are never ``retyped``; a file without a header is recorded as
``unreadable``, and the deliveries around it are compared with each other; where several
renames are possible, those of most agreeing series are taken first, then the first in order
of names, until no pair is left; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.session import cut, narrow

# Spellings of missing cells, type patterns.
MISSING = ["", "n/a", "--"]
NUMBER = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?$|^[+-]?\.\d+$"
DATE_YMD = r"^\d{4}-\d{1,2}-\d{1,2}$"
DATE_DMY = r"^\d{1,2}/\d{1,2}/\d{4}$"
SERIES = r"^[^.\s]+\.[^.\s]+\.[A-Za-z]$"
ISO = r"^([A-Za-z]{3}|[A-Za-z]\d{3})$"
SUBJECT = r"^[A-Za-z]{2,}(_[A-Za-z]+)*$"

# Names (lower case, letters and digits only) under which the key fields are known.
ISO_NAMES = ["iso", "countryiso", "iso3", "refarea", "isocode"]
SUBJECT_NAMES = ["weosubjectcode", "weocode", "subjectcode", "subject"]

#: Files up to which headers and wanted positions (some hundred bytes each) are broadcast.
MAX_BROADCAST_FILES = 20_000

# Canonical columns of the consistent table and the standard names that feed them.
CANONICAL = {
    "dataset": ["dataset"],
    "series_code": ["seriescode", "seriesid", "serieskey"],
    "weo_country_code": ["weocountrycode"],
    "iso": ISO_NAMES,
    "weo_subject_code": SUBJECT_NAMES,
    "country": ["country", "countryname", "economy"],
    "indicator": ["indicator", "subjectdescriptor", "indicatorname", "indicatorlabel", "descriptor"],
    "obs_status": ["obsstatus", "status"],
    "scale": ["scale", "unitmult", "scaling", "multiplier"],
    "unit": ["unit", "units", "measuredin"],
    "updated": ["updated", "lastupdate"],
    "latest_actual": ["latestactual", "lastobs", "estimatesstartafter", "eststart"],
}


def raw_cells(line: Column, delimiter: Column) -> Column:
    """Cells of one line as they stand; only lines with quotes need the pattern of RFC 4180 cells."""

    def cells(d: str) -> Column:
        held = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf'{d}( *"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^{d}]*+)'), F.lit(1))
        return F.when(line.contains('"'), held).otherwise(F.split(line, d))

    return F.when(delimiter == "\t", cells("\t")).otherwise(cells(","))


def clean_cell(x: Column) -> Column:
    """Outer blanks, byte-order marks and RFC 4180 quotes removed."""
    blank = " \t\n\x0b\f\r"
    x = F.btrim(x, F.lit(blank + "\ufeff"))
    inside = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.btrim(inside, F.lit(blank))).otherwise(x)


def value(raw: Column) -> Column:
    """A cell, missing spelt as null."""
    v = clean_cell(raw)
    return F.when(~v.isin(*MISSING, *{m.upper() for m in MISSING}, "N/a", "n/A"), v)


def field_name(x: Column) -> Column:
    return F.regexp_replace(x, r'^[\s"﻿]+|[\s"﻿]+$', "")


def squashed(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def deliveries(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, feed, delivery_no, prev_id, delimiter, names): one row per file; names are null without a header, and such a file is nobody's predecessor."""
    head = lines.filter("line_no = 1 and raw_line is not null").select("file_id", F.when(F.col("raw_line").contains("\t"), "\t").otherwise(",").alias("delimiter"), F.col("raw_line").alias("header"))
    head = head.select("file_id", "delimiter", F.transform(raw_cells(F.col("header"), F.col("delimiter")), lambda x: field_name(clean_cell(x))).alias("names"))
    all_files = files.select("file_id", "feed", "delivery_no").join(head, "file_id", "left")
    w = W.partitionBy("feed", F.col("names").isNull()).orderBy("delivery_no", "file_id")  # one short row per file
    return all_files.withColumn("prev_id", F.when(F.col("names").isNotNull(), F.lag("file_id").over(w)))


def body(schemas: DataFrame, lines: DataFrame, *columns: str) -> DataFrame:
    """Data lines as file_id, line_no, cells (raw) and the named columns of ``schemas``, which also holds file_id and delimiter."""
    data = lines.filter("line_no > 1 and raw_line is not null").select("file_id", "line_no", "raw_line")
    held = narrow(schemas.select("file_id", "delimiter", *columns), MAX_BROADCAST_FILES, "schemas")
    return data.join(held, "file_id").select("file_id", "line_no", raw_cells(F.col("raw_line"), F.col("delimiter")).alias("cells"), *columns)


def field_types(schemas: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, name, places, type, role): type over all cells that are not missing, null where there is none; role of the fields that name a line's series."""
    x = body(schemas, lines).select("file_id", F.posexplode("cells").alias("pos", "raw")).select("file_id", "pos", value(F.col("raw")).alias("v"))
    v = F.col("v")
    short = F.length(v) <= 4  # ISO codes only
    kind = (
        F.when(v.isNull(), None).when(v.rlike(NUMBER), "number").when(v.rlike(DATE_YMD) | v.rlike(DATE_DMY), "date").when(v.rlike(SERIES), "series")
        .when(short & v.rlike(ISO), F.when(v.rlike(SUBJECT), "both").otherwise("iso")).when(v.rlike(SUBJECT), "subject").otherwise("text")
    )
    k = F.col("kind")
    counts = [F.count(k).alias("n"), F.count_if(k == "number").alias("num"), F.count_if(k == "date").alias("dat"), F.count_if(k == "series").alias("ser"), F.count_if(k.isin("iso", "both")).alias("iso"), F.count_if(k.isin("subject", "both")).alias("sub")]
    found = x.select("file_id", "pos", kind.alias("kind")).groupBy("file_id", "pos").agg(*counts)
    fields = schemas.select("file_id", F.posexplode("names").alias("pos", "name")).filter("name <> ''")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "num", "dat", "ser", "iso", "sub")]
    agg = fields.join(found, ["file_id", "pos"], "left").groupBy("file_id", "name").agg(*sums, F.sort_array(F.collect_list("pos")).alias("places"))
    has, all_ = F.col("n") > 0, lambda c: F.col(c) == F.col("n")
    agg = agg.withColumn("type", F.when(has, F.when(all_("num"), "number").when(all_("dat"), "date").otherwise("text")))
    sq, text = squashed(F.col("name")), F.col("type") == "text"
    role = F.when(has & all_("ser"), "1series").when(sq.isin(ISO_NAMES), "2iso").when(sq.isin(SUBJECT_NAMES), "3subject").when(has & all_("iso") & text, "4iso").when(has & all_("sub") & text, "5subject")
    return agg.select("file_id", "name", "places", "type", role.alias("role"))


def versions(schemas: DataFrame, types: DataFrame) -> DataFrame:
    """(file_id, feed, delivery_no, prev_id, fingerprint, moved, version_no): fingerprint of the sorted field:type list; a version ends where it changes."""
    item = F.concat_ws(":", "name", F.coalesce("type", F.lit("?")))
    prints = types.groupBy("file_id").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(item))), 256).alias("fingerprint"))
    x = schemas.filter("names is not null").select("file_id", "feed", "delivery_no", "prev_id").join(prints, "file_id", "left")
    w = W.partitionBy("feed").orderBy("delivery_no", "file_id")
    x = x.withColumn("moved", F.col("prev_id").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w)))
    return x.withColumn("version_no", F.count_if("moved").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1)


def value_pairs(schemas: DataFrame, types: DataFrame, gained: DataFrame, lost: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, old_name, new_name, score): pairs whose values agree for every series in both files.

    Only lines of files with both gained and lost names, and of the deliveries before them, are
    read once more, and of each line only the cells of such names.
    """
    both = gained.select("file_id").distinct().join(lost.select("file_id").distinct(), "file_id").join(schemas.select("file_id", "prev_id"), "file_id")
    at = types.select(F.col("file_id").alias("of"), "name", "places")
    new = gained.join(both, "file_id").select(F.col("file_id").alias("of"), "file_id", "name", F.lit("new").alias("side"))
    old = lost.join(both, "file_id").select(F.col("prev_id").alias("of"), "file_id", "name", F.lit("old").alias("side"))
    want = new.unionByName(old).join(at, ["of", "name"]).groupBy(F.col("of").alias("file_id")).agg(F.collect_list(F.struct("side", "file_id", "name", "places")).alias("want"))
    keys = types.filter("role is not null").select("file_id", "role", F.explode("places").alias("pos")).groupBy("file_id", "role").agg(F.collect_list("pos").alias("at"))
    keys = keys.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "at"))).alias("keys"))
    wanted = cut(schemas.select("file_id", "delimiter").join(want, "file_id").join(keys, "file_id"))
    x = body(wanted, lines, "want", "keys")
    pick = lambda r: F.array_min(F.transform(F.try_element_at("keys", F.lit(r)), lambda p: F.upper(value(F.get("cells", p)))))
    series = F.coalesce(pick("1series"), F.concat_ws(".", F.coalesce(pick("2iso"), pick("4iso")), F.coalesce(pick("3subject"), pick("5subject"))))
    x = x.select(series.alias("series"), "cells", F.explode("want").alias("w")).filter("series <> ''")
    x = x.select("series", "w.side", "w.file_id", "w.name", "cells", F.explode("w.places").alias("p")).select("series", "side", "file_id", "name", value(F.get("cells", F.col("p"))).alias("v")).filter("v is not null")
    v = F.col("v")
    part = lambda sep, k: F.split_part(v, F.lit(sep), F.lit(k))
    dmy = F.concat_ws("-", part("/", 3), F.lpad(part("/", 2), 2, "0"), F.lpad(part("/", 1), 2, "0"))
    ymd = F.concat_ws("-", part("-", 1), F.lpad(part("-", 2), 2, "0"), F.lpad(part("-", 3), 2, "0"))
    x = x.withColumn("v", F.when(v.rlike(DATE_DMY), dmy).when(v.rlike(DATE_YMD), ymd).otherwise(v))
    x = cut(x.groupBy("file_id", "series", "side", "name").agg(F.min("v").alias("v")))
    new = x.filter("side = 'new'").select("file_id", "series", F.col("name").alias("new_name"), "v")
    old = x.filter("side = 'old'").select("file_id", "series", F.col("name").alias("old_name"), "v")
    agree = new.join(old, ["file_id", "series", "v"]).groupBy("file_id", "old_name", "new_name").agg(F.count("*").alias("score"))
    common = agree.join(new.drop("v"), ["file_id", "new_name"]).join(old.drop("v"), ["file_id", "series", "old_name"]).groupBy("file_id", "old_name", "new_name").agg(F.max("score").cast("int").alias("score"), F.count("*").alias("common"))
    return common.filter("score = common").drop("common")


def matched(pairs: DataFrame) -> DataFrame:
    """(file_id, old_name, new_name) of the pairs taken: best score first, then by name, each name once. A file's pairs are bounded by its header."""
    kind = "array<struct<less:int,old_name:string,new_name:string>>"
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "old_name", "new_name")))
    free = lambda acc, p: ~F.exists(acc, lambda q: (q["old_name"] == p["old_name"]) | (q["new_name"] == p["new_name"]))
    taken = F.aggregate("ranked", F.array().cast(kind), lambda acc, p: F.when(free(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return pairs.groupBy("file_id").agg(ranked.alias("ranked")).select("file_id", F.inline(taken)).select("file_id", "old_name", "new_name")


class Drift:
    """The read schemas, field types, versions and recorded steps of a set of files."""

    def __init__(self, files: DataFrame, lines: DataFrame):
        self.lines = lines
        every = cut(deliveries(files, lines))
        self.unreadable = every.filter("names is null").select("file_id", "feed", "delivery_no")
        self.schemas = every.filter("names is not null")
        self.types = cut(field_types(self.schemas, lines))
        self.versions = cut(versions(self.schemas, self.types))

    def changes(self) -> DataFrame:
        """(file_id, field_name, old_name, step, old_type, new_type); step: rename, default (a new field: deliveries before have none), drop, cast."""
        moved = self.versions.filter("moved").select("file_id", "prev_id")
        new = self.types.join(moved, "file_id").select("file_id", "name", F.col("type").alias("new_type"), F.lit(True).alias("is_new"))
        old = self.types.withColumnRenamed("file_id", "prev_id").join(moved, "prev_id").select("file_id", "name", F.col("type").alias("old_type"), F.lit(True).alias("is_old"))
        state = F.when(F.col("is_new") & F.col("is_old"), "kept").when(F.col("is_new"), "gained").otherwise("lost")
        both = cut(new.join(old, ["file_id", "name"], "full_outer").withColumn("state", state).drop("is_new", "is_old"))
        gained, lost = both.filter("state = 'gained'").select("file_id", "name", "new_type"), both.filter("state = 'lost'").select("file_id", "name", "old_type")
        cased = gained.select("file_id", F.col("name").alias("new_name"), F.lower("name").alias("k")).join(lost.select("file_id", F.col("name").alias("old_name"), F.lower("name").alias("k")), ["file_id", "k"])
        cased = cased.select("file_id", "old_name", "new_name", F.lit(1 << 30).alias("score"))
        pairs = cut(matched(cased.unionByName(value_pairs(self.schemas, self.types, gained, lost, self.lines))))
        none = F.lit(None).cast("string")
        g = gained.withColumnRenamed("name", "new_name").join(pairs, ["file_id", "new_name"], "left").join(lost.withColumnRenamed("name", "old_name"), ["file_id", "old_name"], "left")
        g = g.select("file_id", F.col("new_name").alias("field_name"), "old_name", F.when(F.col("old_name").isNotNull(), "rename").otherwise("default").alias("step"), "old_type", "new_type")
        gone = lost.withColumnRenamed("name", "old_name").join(pairs, ["file_id", "old_name"], "left_anti").select("file_id", F.col("old_name").alias("field_name"), "old_name", F.lit("drop").alias("step"), "old_type", none.alias("new_type"))
        cast = both.filter("state = 'kept' and new_type <> old_type").select("file_id", F.col("name").alias("field_name"), F.col("name").alias("old_name"), F.lit("cast").alias("step"), "old_type", "new_type")
        return g.unionByName(gone).unionByName(cast)


def registry(d: Drift) -> DataFrame:
    """The recorded migration steps: feed, file_id, delivery_no, version_no, fingerprint, step, field_name, old_name, old_type, new_type.

    Besides the steps of ``changes``, the first delivery of a feed has one step ``first`` and a
    file without a header one step ``unreadable``, both without a field.
    """
    none = F.lit(None).cast("string")
    blank = [none.alias(c) for c in ("field_name", "old_name", "old_type", "new_type")]
    steps = d.changes().join(d.versions.select("file_id", "feed", "delivery_no", "version_no", "fingerprint"), "file_id")
    first = d.versions.filter("prev_id is null").select("file_id", "feed", "delivery_no", "version_no", "fingerprint", F.lit("first").alias("step"), *blank)
    lost = d.unreadable.select("file_id", "feed", "delivery_no", F.lit(None).cast("bigint").alias("version_no"), none.alias("fingerprint"), F.lit("unreadable").alias("step"), *blank)
    return steps.unionByName(first).unionByName(lost)


def origins(d: Drift, steps: DataFrame, max_deliveries: int) -> DataFrame:
    """(file_id, name, origin): each field's name in the delivery where it first appeared.

    The rename steps form chains over the deliveries of a feed; they are followed by pointer
    doubling, so a chain of n deliveries takes log2(n) joins.
    """
    step = steps.filter("step in ('rename', 'default')").select("file_id", F.col("field_name").alias("name"), "old_name", "step")
    node = d.types.select("file_id", "name").join(d.schemas.select("file_id", "prev_id"), "file_id").join(step, ["file_id", "name"], "left")
    root = F.col("prev_id").isNull() | (F.col("step") == "default")
    at = F.when(F.coalesce(root, F.lit(False)), F.struct("file_id", "name")).otherwise(F.struct(F.col("prev_id").alias("file_id"), F.coalesce("old_name", "name").alias("name")))
    node = cut(node.select("file_id", "name", at.alias("at")))
    for _ in range(max(1, math.ceil(math.log2(max(2, max_deliveries))))):
        up = node.select(F.struct("file_id", "name").alias("at"), F.col("at").alias("further"))
        node = cut(node.join(up, "at", "left").select("file_id", "name", F.coalesce("further", "at").alias("at")))
    return node.select("file_id", "name", F.col("at.name").alias("origin"))


def routes(d: Drift, steps: DataFrame) -> DataFrame:
    """(file_id, name, origin, target, rule, places): the column that every field of every file goes to.

    target: a canonical column, ``@year`` or ``+first name``; rule: ``number``, ``date`` or
    ``text``, the cast of its cells.
    """
    longest = d.schemas.groupBy("feed").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    names = origins(d, steps, longest)
    sq = squashed(F.col("origin"))
    target = F.when(F.col("origin").rlike(r"^[Yy]?_?\d{4}$"), F.concat(F.lit("@"), F.regexp_extract("origin", r"(\d{4})", 1)))
    for column, known in CANONICAL.items():
        target = target.when(sq.isin(known), column)
    target = target.otherwise(F.concat(F.lit("+"), "origin"))
    rule = F.when(F.col("target").startswith("@"), "number").when(F.col("target") == "updated", "date").otherwise("text")
    return names.withColumn("target", target).withColumn("rule", rule).join(d.types.select("file_id", "name", "places"), ["file_id", "name"])


def migration_steps(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every step that takes a file to the consistent table: file_id, version_no, fingerprint, step, field_name, target, rule.

    ``rename``: the field's column; ``cast``: what its cells are read as, where not text;
    ``default``: a canonical column that the file lacks, null there.
    """
    d = Drift(files, lines)
    r = cut(routes(d, registry(d)))
    v = d.versions.select("file_id", "version_no", "fingerprint")
    none = F.lit(None).cast("string")
    rename = r.select("file_id", F.lit("rename").alias("step"), F.col("name").alias("field_name"), "target", "rule")
    cast = r.filter("rule <> 'text'").select("file_id", F.lit("cast").alias("step"), F.col("name").alias("field_name"), "target", "rule")
    has = r.groupBy("file_id").agg(F.collect_set("target").alias("has"))
    lacks = v.select("file_id").join(has, "file_id", "left").select("file_id", F.lit("default").alias("step"), none.alias("field_name"), F.explode(F.array_except(F.array(*map(F.lit, CANONICAL)), F.coalesce("has", F.array().cast("array<string>")))).alias("target"), F.lit("null").alias("rule"))
    return rename.unionByName(cast).unionByName(lacks).join(v, "file_id").select("file_id", "version_no", "fingerprint", "step", "field_name", "target", "rule")


def consistent_table(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per data line of every delivery under canonical names.

    rename: the chain of renames leads to the first name, which the standard names map to a
    column; default: a column that a file lacks is null; cast: number cells lose their commas
    and become doubles, dates become dates. Year fields are in ``obs`` (JSON of year to
    double), fields outside the canonical list in ``extra`` (JSON of first name to text).
    """
    d = Drift(files, lines)
    r = routes(d, registry(d)).select("file_id", "target", F.explode("places").alias("p")).groupBy("file_id", "target").agg(F.sort_array(F.collect_list("p")).alias("places"))
    kept = lambda p: F.sort_array(F.collect_list(F.when(p, F.struct(F.substr("target", F.lit(2)).alias("k"), "places"))))
    own = F.collect_list(F.when(F.col("target").isin(*CANONICAL), F.struct("target", "places")))
    r = r.groupBy("file_id").agg(F.map_from_entries(own).alias("own"), kept(F.col("target").startswith("@")).alias("years"), kept(F.col("target").startswith("+")).alias("others"))
    held = d.schemas.select("file_id", "delimiter").join(r, "file_id").join(d.versions.select("file_id", "feed", "delivery_no", "version_no", "fingerprint"), "file_id")
    x = body(cut(held), lines, "feed", "delivery_no", "version_no", "fingerprint", "own", "years", "others")
    first = lambda places: F.try_element_at(F.filter(F.transform(places, lambda p: value(F.get("cells", p))), lambda v: v.isNotNull()), F.lit(1))
    one = lambda column: first(F.try_element_at("own", F.lit(column)))
    number = lambda v: F.regexp_replace(v, ",", "").try_cast("double")

    def as_map(fields: str, read) -> Column:
        cells = F.filter(F.transform(fields, lambda f: F.struct(f["k"].alias("k"), first(f["places"]).alias("v"))), lambda e: e["v"].isNotNull())
        return F.to_json(F.map_from_entries(F.transform(cells, lambda e: F.struct(e["k"].alias("k"), read(e["v"]).alias("v")))))

    cols = [one(c).alias(c) for c in CANONICAL if c != "updated"]
    u = one("updated")
    updated = F.coalesce(F.when(u.rlike(DATE_YMD), F.try_to_date(u, "y-M-d")), F.when(u.rlike(DATE_DMY), F.try_to_date(u, "d/M/y"))).alias("updated")
    return x.select("file_id", "line_no", "feed", "delivery_no", "version_no", "fingerprint", *cols, updated, as_map("years", number).alias("obs"), as_map("others", lambda v: v).alias("extra"))


def found(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, field_name, change) read from the registry."""
    steps = registry(Drift(files, lines))
    change = F.create_map(*map(F.lit, ("rename", "renamed", "default", "added", "drop", "removed", "cast", "retyped")))
    return steps.filter("field_name is not null").select("file_id", "field_name", change[F.col("step")].alias("change")).distinct()
