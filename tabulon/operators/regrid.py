"""Irregular readings onto a regular grid (problem 6).

Readings become a step function: each is valid from its instant to the next reading of its
source, at most ``hold`` periods long. The validity intervals are intersected with the grid
cells; a cell gets the time-weighted average, the fraction of it that is covered, and a
mark when no reading fell into it.

The readings of a source are first reduced to one row per (source, period); a source that
holds a third of all rows is thus split over its periods, and the window over a source sees
at most one row per period between years 1 and 9999.

Defined results: rows without source or period give nothing; a value that is null or NaN
counts as a reading, has no level and ends the one before it; of readings at the same instant
the last by the tie column stands; a source with one period gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.session import code


def step_grid(readings: DataFrame, hold: float = 1.0) -> DataFrame:
    """readings: source, period (long index without holes), frac (0 to below 1), tie, value.

    Returns source, period, n_readings, value, coverage, is_filled.
    """
    r = readings.filter("source is not null and period is not null")
    r = r.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    w = W.partitionBy("source", "period").orderBy("frac", "tie")
    r = r.withColumn("until", F.coalesce(F.lead("frac").over(w), F.lit(1.0)))
    level = F.col("value") * (F.col("until") - F.col("frac"))
    width = F.when(F.col("value").isNotNull(), F.col("until") - F.col("frac"))
    at = F.struct("frac", "tie")
    cell = r.groupBy("source", "period").agg(
        F.count("*").alias("n"), F.sum(level).alias("area"), F.sum(width).alias("width"), F.min("frac").alias("first_at"), F.max("frac").alias("last_at"),
        F.max_by("value", at).alias("last_value"), F.avg("value").alias("mean"),
    )
    s = W.partitionBy("source").orderBy("period")
    cell = cell.withColumn("next", F.lead("period").over(s)).withColumn("prev", F.lag("period").over(s)).withColumn("prev_at", F.lag("last_at").over(s)).withColumn("prev_value", F.lag("last_value").over(s))
    cell = cell.withColumn("g", F.explode(F.sequence(F.col("period"), F.coalesce(F.col("next") - 1, F.col("period")))))
    own = F.col("g") == F.col("period")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    # the last value before this cell reaches into it up to prev + prev_at + hold, and never past the first reading
    carried = F.when(F.col("prev_value").isNotNull(), F.least(F.col("first_at"), clip(F.col("prev") + F.col("prev_at") + hold - F.col("period")))).otherwise(F.lit(0.0))
    in_hole = F.when(F.col("last_value").isNotNull(), clip(F.col("period") + F.col("last_at") + hold - F.col("g"))).otherwise(F.lit(0.0))
    covered = F.coalesce("width", F.lit(0.0)) + carried
    total = F.coalesce("area", F.lit(0.0)) + carried * F.coalesce("prev_value", F.lit(0.0))
    average = F.coalesce(F.try_divide(total, covered), "mean")
    return cell.select(
        "source", F.col("g").alias("period"), F.when(own, F.col("n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(own, average).otherwise(F.col("last_value")).alias("value"), F.when(own, covered).otherwise(in_hole).alias("coverage"), (~own).alias("is_filled"),
    )


def whole(c: str, low: int, high: int) -> Column:
    """The column as a whole number in [low, high], else null."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (x == F.floor(x)) & x.between(low, high), x.cast("long"))


def airline_grid(airline: DataFrame) -> DataFrame:
    """Carrier by month; period = year * 100 + month. A reading's instant is read_at inside its month, else the nearer end."""
    ok = (F.col("passengers") > 0) & ~F.isnan("passengers")
    a = airline.filter(ok).select(code("carrier").alias("source"), whole("year", 1, 9999).alias("y"), whole("month", 1, 12).alias("m"), F.col("passengers").alias("value"), "read_at", F.col("row_id").alias("tie"))
    a = a.withColumn("period", F.col("y") * 12 + F.col("m") - 1)
    start = F.make_timestamp_ntz(F.col("y").cast("int"), F.col("m").cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    days = F.date_diff(F.add_months(start.cast("date"), 1), start.cast("date"))
    at = F.unix_micros(F.col("read_at").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.coalesce(at / (days * 86_400_000_000.0), F.lit(0.0))))
    a = a.withColumn("frac", inside).select("source", "period", "frac", "tie", "value")
    g = step_grid(a)
    return g.withColumn("period", F.floor(F.col("period") / 12) * 100 + F.col("period") % 12 + 1)


def panel_grid(panel: DataFrame, regions: DataFrame, value: str = "gdp") -> DataFrame:
    """Territory by year, for territories known to ``regions`` at any time; a later load replaces an earlier one."""
    known = regions.select(code("country").alias("source")).filter("source is not null").distinct()
    v = F.col(value)
    p = panel.select(code("country").alias("source"), whole("year", 1, 9999).alias("period"), F.lit(0.0).alias("frac"), F.struct("loaded_at", "row_id").alias("tie"), F.when((v > 0) & (v < 1e12), v).alias("value"))
    return step_grid(p.join(known, "source", "left_semi"))
