"""Calendar functions: periods are numbers counted from 1960 (days, months, quarters, weeks of 52 a year, half-years, years)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.missing import col

EPOCH = "1960-01-01"
# Month names and their numbers.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _epoch() -> Column:
    return F.lit(EPOCH).cast("date")


def days(x) -> Column:
    """A date or timestamp column as days since 1960."""
    return F.datediff(col(x).cast("date"), _epoch()).cast("double")


def as_date(d) -> Column:
    return F.date_add(_epoch(), F.floor(col(d)).cast("int"))


def mdy(m, d, y) -> Column:
    """Invalid dates are missing."""
    text = F.format_string("%04d-%02d-%02d", col(y).cast("int"), col(m).cast("int"), col(d).cast("int"))
    some = col(m).isNotNull() & col(d).isNotNull() & col(y).isNotNull()
    return F.when(some, F.datediff(F.try_to_date(text, "yyyy-MM-dd"), _epoch())).cast("double")


def ym(y, m) -> Column:
    return F.when(col(m).between(1, 12), (col(y) - 1960) * 12 + col(m) - 1).cast("double")


def yq(y, q) -> Column:
    return F.when(col(q).between(1, 4), (col(y) - 1960) * 4 + col(q) - 1).cast("double")


def yh(y, h) -> Column:
    return F.when(col(h).between(1, 2), (col(y) - 1960) * 2 + col(h) - 1).cast("double")


def yw(y, w) -> Column:
    return F.when(col(w).between(1, 52), (col(y) - 1960) * 52 + col(w) - 1).cast("double")


def year(d) -> Column:
    return F.year(as_date(d)).cast("double")


def month(d) -> Column:
    return F.month(as_date(d)).cast("double")


def day(d) -> Column:
    return F.dayofmonth(as_date(d)).cast("double")


def quarter(d) -> Column:
    return F.quarter(as_date(d)).cast("double")


def halfyear(d) -> Column:
    return F.ceil(F.month(as_date(d)) / 6).cast("double")


def doy(d) -> Column:
    return F.dayofyear(as_date(d)).cast("double")


def dow(d) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(as_date(d)) - 1).cast("double")


def week(d) -> Column:
    """Weeks of seven days from January 1; the last one takes the rest of the year."""
    return F.least(F.floor((F.dayofyear(as_date(d)) - 1) / 7) + 1, F.lit(52)).cast("double")


def mofd(d) -> Column:
    return ((year(d) - 1960) * 12 + month(d) - 1).cast("double")


def qofd(d) -> Column:
    return ((year(d) - 1960) * 4 + quarter(d) - 1).cast("double")


def hofd(d) -> Column:
    return ((year(d) - 1960) * 2 + halfyear(d) - 1).cast("double")


def wofd(d) -> Column:
    return ((year(d) - 1960) * 52 + week(d) - 1).cast("double")


def yofd(d) -> Column:
    return year(d)


def _first_of(y: Column, m: Column) -> Column:
    return F.when(y.isNotNull() & m.isNotNull(), F.datediff(F.make_date(y.cast("int"), m.cast("int"), F.lit(1)), _epoch())).cast("double")


def dofm(m) -> Column:
    return _first_of(1960 + F.floor(col(m) / 12), F.pmod(col(m), F.lit(12)) + 1)


def dofq(q) -> Column:
    return _first_of(1960 + F.floor(col(q) / 4), F.pmod(col(q), F.lit(4)) * 3 + 1)


def dofh(h) -> Column:
    return _first_of(1960 + F.floor(col(h) / 2), F.pmod(col(h), F.lit(2)) * 6 + 1)


def dofy(y) -> Column:
    return _first_of(col(y), F.lit(1))


def _numbers(x, k: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(x), F.lit(r"(\d+)"), F.lit(1)), F.lit(k)).try_cast("int")


def _year4(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def quarterly(x) -> Column:
    """Text such as 2020-Q3; out of range is missing."""
    return yq(_year4(_numbers(x, 1)), _numbers(x, 2))


def monthly(x) -> Column:
    return ym(_year4(_numbers(x, 1)), _numbers(x, 2))


def halfyearly(x) -> Column:
    return yh(_year4(_numbers(x, 1)), _numbers(x, 2))


def weekly(x) -> Column:
    return yw(_year4(_numbers(x, 1)), _numbers(x, 2))


def yearly(x) -> Column:
    return _year4(_numbers(x, 1)).cast("double")


def daily(x, mask: str) -> Column:
    """Text to days by a mask of D, M and Y; months by number or English name."""
    t = F.lower(col(x))
    for i, name in enumerate(MONTHS, 1):
        t = F.regexp_replace(t, rf"{name}[a-z]*", f" {i} ")
    part = {c: F.try_element_at(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), F.lit(k)).try_cast("int") for k, c in enumerate(mask.upper(), 1)}
    return mdy(part["M"], part["D"], _year4(part["Y"]))


# --- constants, as numbers that can be compared with a period column -----------------


def td(text: str) -> float:
    """Days of a text such as 5jan2020."""
    m = re.fullmatch(r"(\d{1,2})\s*([a-z]{3})[a-z]*\s*(\d{4})", text.strip().lower())
    return float((dt.date(int(m[3]), MONTHS.index(m[2]) + 1, int(m[1])) - dt.date(1960, 1, 1)).days)


def _period(text: str, letter: str, per_year: int) -> float:
    m = re.fullmatch(rf"(\d{{4}})\s*{letter}\s*(\d{{1,2}})", text.strip().lower())
    if not m or not 1 <= int(m[2]) <= per_year:
        raise ValueError(f"no period: {text}")
    return float((int(m[1]) - 1960) * per_year + int(m[2]) - 1)


def tm(text: str) -> float:
    """Months of 2020m3; ``tq``, ``th`` and ``tw`` alike for 2020q1, 2020h1 and 2020w1."""
    return _period(text, "m", 12)


def tq(text: str) -> float:
    return _period(text, "q", 4)


def th(text: str) -> float:
    return _period(text, "h", 2)


def tw(text: str) -> float:
    return _period(text, "w", 52)
