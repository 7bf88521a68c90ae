"""Rows that fail to parse (problem 3).

A schema is the delimiter and the column order of a header. From it one anchored pattern for
whole rows is generated; rows that match are typed at once. The rest goes through the prefix
patterns of the same schema, field by field: where they break off names the broken field, and
what is left of the row there tells the reason.

Defined results: rows of a file without a readable header are ``column_count``; a null or
empty line is a row of one empty cell; extra input columns are ignored; repeated lines are
each judged; empty inputs give empty results. Quantifiers are possessive, so cells of any
length neither backtrack nor overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut, narrow

# Columns of the two record kinds, spellings of a missing cell.
KINDS = {"panel": ["country", "year", "gdp", "pop"], "grunfeld": ["firm", "year", "invest", "value", "capital"]}
MISSING = ["", ".", "n/a", "NA", "--", "-"]
DELIMITERS = ["\t", ";", "|", ","]

#: Files up to which their headers (some fifty bytes each) are broadcast.
MAX_BROADCAST_FILES = 100_000

QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_GAP = r"(?:\.|n/a|NA|--|-|)"
_TAIL = r"(?:\.\d*)?(?:[eE][+-]?\d+)?"
_PLAIN = rf"[+-]?(?:\d+{_TAIL}|\.\d+(?:[eE][+-]?\d+)?)"
_COMMAS = rf"[+-]?(?:\d{{1,3}}(?:,\d{{3}})+{_TAIL}|\d+{_TAIL}|\.\d+(?:[eE][+-]?\d+)?)"
_YEAR = r"(?:19\d\d|20\d\d|2100)"
_FIRM = r"0*[1-9]\d*"


def free_cell(d: str) -> str:
    """Any RFC 4180 cell under delimiter ``d``."""
    return f'(?:{QUOTED}|[^"{d}\\r\\n]*+)'


def field_pattern(name: str, d: str) -> str:
    """Pattern of one valid cell of field ``name`` under delimiter ``d``."""
    blank = " *" if d == "\t" else r"[ \t]*"
    if name == "country":
        bare = rf'{blank}(?!(?:NA|n/a){blank}(?:[{d}]|\r?\z))(?=[^"{d}\p{{L}}]*+\p{{L}})[^"{d}\p{{Cc}}\x{{FFFD}}]*+{blank}'
        held = r'"[ \t]*(?!(?:NA|n/a)[ \t]*")(?=(?:[^"\p{L}]++|"")*+\p{L})(?:[^"\p{Cc}\x{FFFD}]++|""|[\r\n]++)*+\t*"'
        return f"(?:{held}|{bare})"
    inside = {"year": _YEAR, "firm": _FIRM}.get(name, f"(?:{_COMMAS}|{_GAP})")
    bare = {"year": _YEAR, "firm": _FIRM}.get(name, f"(?:{_PLAIN if d == ',' else _COMMAS}|{_GAP})")
    return f'(?:"[ \\t]*{inside}[ \\t]*"|{blank}{bare}{blank})'


def headers(records: DataFrame) -> DataFrame:
    """(file_id, d, names): delimiter and column order of every file whose header is of one of the kinds."""
    h = records.filter("line_no = 1").select("file_id", F.regexp_replace("raw_line", "[﻿\r\n]", "").alias("h"))
    d = F.lit(",")
    for x in reversed(DELIMITERS):
        d = F.when(F.col("h").contains(x), x).otherwise(d)
    h = h.withColumn("d", d)
    names = F.transform(F.split("h", F.concat(F.lit("["), "d", F.lit("]"))), lambda x: F.regexp_replace(x, r'^[ \t"]+|[ \t"]+$', ""))
    h = h.withColumn("names", names)
    is_kind = lambda cols: F.sort_array("names") == F.array(*map(F.lit, sorted(cols)))
    return h.filter(is_kind(KINDS["panel"]) | is_kind(KINDS["grunfeld"])).select("file_id", "d", "names")


def schemas(heads: DataFrame) -> DataFrame:
    """(d, names, kind, fields, whole): one row per schema, at most one per delimiter and column order (4! + 5! orders, four delimiters).

    fields are the cell patterns in column order, whole is the anchored pattern of a row.
    """
    all_names = sorted({n for cols in KINDS.values() for n in cols})

    def patterns(x: str) -> Column:
        by_name = F.create_map(*[F.lit(v) for n in all_names for v in (n, field_pattern(n, x))])
        return F.transform("names", lambda n: F.try_element_at(by_name, n))

    fields = F.lit(None)
    for x in DELIMITERS:
        fields = F.when(F.col("d") == x, patterns(x)).otherwise(fields)
    kind = F.when(F.array_contains("names", "firm"), "grunfeld").otherwise("panel")
    s = heads.select("d", "names").distinct().select("d", "names", kind.alias("kind"), fields.alias("fields"))
    whole = F.concat(F.lit("^"), F.array_join("fields", "§§"), F.lit(r"\r?\z"))
    return s.withColumn("whole", F.replace(whole, F.lit("§§"), F.concat(F.lit("["), "d", F.lit("]"))))


def judged(records: DataFrame) -> DataFrame:
    """All records but the headers, with the schema of their file and ``ok``: matches the whole-row pattern."""
    heads = cut(headers(records))  # read once for the bound, the schemas and the join
    r = records.filter("line_no > 1").select("file_id", "line_no", F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    r = r.join(narrow(heads, MAX_BROADCAST_FILES, "headers"), "file_id", "left")
    r = r.join(F.broadcast(schemas(heads)), ["d", "names"], "left")
    # regexp_instr keeps the compiled pattern while it stays the same, as it does along a file's rows
    return r.withColumn("ok", F.coalesce(F.regexp_instr("raw_line", F.col("whole")) == 1, F.lit(False)))


def rejected(records: DataFrame) -> DataFrame:
    """(file_id, line_no, reason, field, raw_line) of every record that is no valid panel or grunfeld record.

    Two series of prefix patterns are tried, one field longer each: of any RFC 4180 cells and of
    valid cells. Where the first breaks off with nothing left of the row, cells are missing;
    with something left, a cell is not RFC 4180. Where all its cells are there, what follows
    them are surplus cells or a broken one, and if nothing follows, the field at which the
    series of valid cells breaks off has a bad value.
    """
    bad = judged(records).filter("not ok")
    n, known = F.size("names"), F.col("kind").isNotNull()
    sep = F.concat(F.lit("["), "d", F.lit("]"))
    # every cell is ended by a delimiter, the last one by one put there
    bad = bad.withColumn("ended", F.concat(F.regexp_replace("raw_line", r"\r\z", ""), "d"))
    cell = F.lit(None)
    for d in DELIMITERS:
        cell = F.when(F.col("d") == d, free_cell(d)).otherwise(cell)
    bad = bad.withColumn("shape", F.concat(F.lit("(?:"), cell, sep, F.lit(")")))
    cells = lambda k: F.concat(F.lit("^"), "shape", F.lit("{"), k.cast("string"), F.lit("}"))
    values = lambda k: F.concat(F.lit("^"), F.array_join(F.transform(F.slice("fields", F.lit(1), k), lambda f: F.concat(f, sep)), ""))
    broken = lambda prefix: F.try_element_at(F.filter(F.sequence(F.lit(1), n), lambda k: F.regexp_instr("ended", prefix(k)) == 0), F.lit(1))
    bad = bad.withColumn("shape_at", F.when(known, broken(cells))).withColumn("value_at", F.when(known, broken(values)))
    left = F.regexp_replace("ended", cells(F.coalesce(F.col("shape_at") - 1, n)), F.lit(""))
    bad = bad.withColumn("left", F.when(known, left))
    surplus = F.regexp_instr("left", F.concat(F.lit("^"), "shape", F.lit(r"*+\z"))) == 1
    nothing = F.col("left") == ""
    reason = (
        F.when(~known, "column_count")
        .when(F.col("shape_at").isNotNull(), F.when(nothing, "column_count").otherwise("quoting"))
        .when(~nothing, F.when(surplus, "column_count").otherwise("quoting"))
        .otherwise("bad_value")
    )
    return bad.select("file_id", "line_no", reason.alias("reason"), F.try_element_at("names", F.col("value_at")).alias("field"), "raw_line")


def valid(records: DataFrame) -> DataFrame:
    """Typed valid records of both kinds: file_id, line_no, kind and the columns of the kinds, missing cells null."""
    good = judged(records).filter("ok")
    cells = F.lit(None)
    for d in DELIMITERS:
        cells = F.when(F.col("d") == d, F.regexp_extract_all(F.concat(F.lit(d), F.regexp_replace("raw_line", r"\r\z", "")), F.lit(f"[{d}]({free_cell(d)})"), F.lit(1))).otherwise(cells)
    good = good.withColumn("cells", cells)

    def cell(name: str) -> Column:
        x = F.try_element_at("cells", F.array_position("names", name).cast("int"))
        x = F.when(F.array_contains("names", name), x)
        x = F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
        x = F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")
        return F.when(~x.isin(MISSING), x)

    number = lambda name: F.regexp_replace(cell(name), ",", "").try_cast("double").alias(name)
    return good.select("file_id", "line_no", "kind", cell("country").alias("country"), cell("firm").try_cast("long").alias("firm"), cell("year").try_cast("int").alias("year"), *map(number, ["gdp", "pop", "invest", "value", "capital"]))
