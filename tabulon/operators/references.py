"""References to records that do not exist (problem 4).

Distinct non-null foreign keys are anti-joined with the parent keys; what has a parent is
then judged against the parent's life times. Results are per row, and counted per table,
field and period.

Defined results: null or blank keys are no reference; a row without a time can only be
``missing``; a parent without created_at has lived from the start, one without deleted_at
lives on; lives that touch or overlap are merged; repeated rows are each listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.session import code

START, END = "timestamp_ntz '0001-01-01'", "timestamp_ntz '9999-12-31'"


def lives(parent: DataFrame, key: str, created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """(k, born, died): disjoint life times per parent key."""
    p = parent.select(code(key).alias("k"), F.coalesce(created, F.expr(START)).alias("born"), F.coalesce(deleted, F.expr(END)).alias("died"))
    p = p.filter("k is not null").groupBy("k", "born").agg(F.max("died").alias("died"))
    w = W.partitionBy("k").orderBy("born")  # distinct (key, creation) pairs of the parent, not its rows
    p = p.withColumn("reach", F.max("died").over(w.rowsBetween(W.unboundedPreceding, -1)))
    p = p.withColumn("part", F.sum(F.when(F.col("born") <= F.col("reach"), 0).otherwise(1)).over(w))
    return p.groupBy("k", "part").agg(F.min("born").alias("born"), F.max("died").alias("died")).drop("part")


def orphans(child: DataFrame, tbl: str, fld: str, row_key: str, at: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(tbl, fld, row_id, at, kind): references of ``child.fld`` with no target alive at ``at``."""
    refs = child.select(F.col(row_key).alias("row_id"), code(fld).alias("k"), F.col(at).alias("at")).filter("k is not null")
    life = lives(parent, parent_key)
    first = life.groupBy("k").agg(F.min("born").alias("first_born"))
    absent = refs.select("k").distinct().join(first, "k", "left_anti")
    missing = refs.join(absent, "k", "left_semi").withColumn("kind", F.lit("missing"))
    timed = refs.filter("at is not null").join(first, "k")  # references whose key exists
    alive = (timed["k"] == life["k"]) & (life["born"] <= timed["at"]) & (timed["at"] < life["died"])
    dead = timed.join(life, alive, "left_anti")
    dead = dead.withColumn("kind", F.when(F.col("first_born") > F.col("at"), "late").otherwise("deleted")).drop("first_born")
    return missing.unionByName(dead).select(F.lit(tbl).alias("tbl"), F.lit(fld).alias("fld"), "row_id", "at", "kind")


def all_orphans(panel: DataFrame, regions: DataFrame, country_ref: DataFrame, region_ref: DataFrame) -> DataFrame:
    return (
        orphans(panel, "panel", "country", "row_id", "loaded_at", regions, "country")
        .unionByName(orphans(regions, "regions", "country", "row_id", "created_at", country_ref, "country"))
        .unionByName(orphans(regions, "regions", "region", "row_id", "created_at", region_ref, "region"))
    )


def counts(orphaned: DataFrame, unit: str = "month") -> DataFrame:
    """Orphans per table, field, kind and period."""
    period = F.date_format(F.date_trunc(unit, "at"), "yyyy-MM")
    return orphaned.groupBy("tbl", "fld", "kind", period.alias("period")).agg(F.count("*").alias("n_rows"))
