"""String functions on Columns; NULL and the empty string are the same missing string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.missing import col

ENDS = r"^[ \t]+|[ \t]+$"


def s(x) -> Column:
    return F.coalesce(col(x), F.lit(""))


def strlen(x) -> Column:
    """Bytes."""
    return F.octet_length(s(x))


def upper(x) -> Column:
    return F.upper(s(x))


def lower(x) -> Column:
    return F.lower(s(x))


def trim(x) -> Column:
    return F.btrim(s(x), F.lit(" \t"))


def ltrim(x) -> Column:
    return F.ltrim(s(x), F.lit(" \t"))


def rtrim(x) -> Column:
    return F.rtrim(s(x), F.lit(" \t"))


def itrim(x) -> Column:
    """Runs of blanks and tabs to one blank."""
    return F.regexp_replace(s(x), "[ \t]+", " ")


def reverse(x) -> Column:
    return F.reverse(s(x))


def proper(x) -> Column:
    """Capital after a blank, hyphen, slash or apostrophe, lower case elsewhere."""
    parts = F.split(F.lower(s(x)), r"(?<=[ \-/'])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def strpos(x, part: str) -> Column:
    return F.instr(s(x), part)


def strrpos(x, part: str) -> Column:
    """Position of the last occurrence, 0 if none."""
    at = F.instr(F.reverse(s(x)), part[::-1])
    return F.when(at == 0, 0).otherwise(F.length(s(x)) - at - len(part) + 2)


def substr(x, start, n=None) -> Column:
    """From a 1-based or, if negative, end-based position; without n to the end."""
    n = F.length(s(x)) if n is None else col(n)
    return F.substring(s(x), col(start), n)


def subinstr(x, old: str, new: str, n: int | None = None) -> Column:
    """All, or the first n, occurrences."""
    if not old:
        return s(x)
    if n is None or n < 0:
        return F.replace(s(x), F.lit(old), F.lit(new))
    parts = F.split(s(x), re.escape(old))
    head = F.array_join(F.slice(parts, F.lit(1), F.lit(n + 1)), new)
    tail = F.slice(parts, F.lit(n + 2), F.greatest(F.size(parts) - n - 1, F.lit(0)))
    return F.when(F.size(parts) > n + 1, F.concat(head, F.lit(old), F.array_join(tail, old))).otherwise(head)


def subinword(x, old: str, new: str) -> Column:
    """Whole words only."""
    return F.regexp_replace(s(x), rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])", new.replace("\\", "\\\\").replace("$", "\\$"))


def words(x) -> Column:
    return F.filter(F.split(s(x), r"\s+"), lambda w: w != "")


def word(x, n: int) -> Column:
    """The n-th word, counted from the end if n is negative; empty if there is none."""
    return F.coalesce(F.try_element_at(words(x), F.lit(n)), F.lit(""))


def wordcount(x) -> Column:
    return F.size(words(x))


def abbrev(x, n: int) -> Column:
    return F.when(F.length(s(x)) > n, F.concat(F.substring(s(x), 1, n - 1), F.lit("~"))).otherwise(s(x))


def strdup(x, n: int) -> Column:
    return F.repeat(s(x), n)


def char(n) -> Column:
    return F.chr(col(n))


def string(x, decimals: int | None = None) -> Column:
    """A number as text: whole numbers without decimals, others in full (or with so many decimals); missing is '.'."""
    v = col(x).cast("double")
    if decimals is not None:
        return F.when(v.isNull(), ".").otherwise(F.format_string(f"%.{decimals}f", v))
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v.isNull(), ".").when(whole, F.format_string("%.0f", v)).otherwise(v.cast("string"))


def strofreal(x, fmt: str) -> Column:
    """A number by a format %[-][0][width][.digits]kind: f fixed, e with an exponent, g the shorter of the two in so many significant digits; missing is '.'."""
    m = re.fullmatch(r"%(-?)(0?)(\d*)(?:\.(\d+))?([feg])", fmt)
    if not m:
        raise ValueError(f"no number format: {fmt}")
    left, zeros, width, digits, kind = m.groups()
    v = col(x).cast("double")
    d = 6 if digits is None else int(digits)
    text = lambda k: F.format_string(f"%.{k}f", v)
    power = lambda k: F.format_string(f"%.{k}e", v)
    if kind == "g":
        d = max(d, 1)
        at = F.when(v == 0, 0).otherwise(F.regexp_extract(power(d - 1), r"e([+-]\d+)$", 1).cast("int"))
        fixed = F.element_at(F.array(*[text(d - 1 - e) for e in range(-4, d)]), F.greatest(F.lit(1), F.least(F.lit(d + 4), at + 5)))
        fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
        body = F.when(at.between(-4, d - 1), fixed).otherwise(F.regexp_replace(power(d - 1), r"(\.\d*?)0+e", "$1e"))
        body = F.regexp_replace(body, r"\.e", "e")
    else:
        body = text(d) if kind == "f" else power(d)
    out = F.when(v.isNull(), ".").otherwise(body)
    if not width:
        return out
    w = F.greatest(F.length(out), F.lit(int(width)))
    return F.rpad(out, w, F.lit(" ")) if left else F.lpad(out, w, F.lit("0" if zeros else " "))


def real(x) -> Column:
    """The whole text as a number, or missing."""
    t = trim(x)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def glob_pattern(glob: str) -> str:
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + ")$"


def strmatch(x, glob: str) -> Column:
    return s(x).rlike(glob_pattern(glob))


def strtoname(x) -> Column:
    """A legal name: other characters to '_', '_' before a digit, 32 characters at most."""
    t = F.regexp_replace(s(x), "[^A-Za-z0-9_]", "_")
    return F.substring(F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t), 1, 32)


def regexm(x, pattern: str) -> Column:
    return s(x).rlike(pattern)


def regexs(x, pattern: str, group: int) -> Column:
    """Group of the first match of the pattern in x; empty without a match."""
    return F.regexp_extract(s(x), pattern, group)


def regexr(x, pattern: str, new: str) -> Column:
    """First match only."""
    at, hit = F.regexp_instr(s(x), F.lit(pattern)), F.regexp_extract(s(x), pattern, 0)
    done = F.concat(F.substring(s(x), F.lit(1), at - 1), F.lit(new), F.substring(s(x), at + F.length(hit), F.length(s(x))))
    return F.when(at > 0, done).otherwise(s(x))


def concat(*xs) -> Column:
    return F.concat(*map(s, xs))
