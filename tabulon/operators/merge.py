"""merge 1:1, m:1, 1:m on keys, missing keys matching each other.

``_merge`` is 1 (master only), 2 (using only) or 3. What ``keep`` leaves decides the join
type, so that a filter on ``_merge`` never costs a full outer join. A hot key is split by
adaptive execution for the inner, left and right joins; key uniqueness on the declared side
makes sure that rows never multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.prep import DataError

NAMES = {"master": 1, "using": 2, "match": 3, "1": 1, "2": 2, "3": 3, 1: 1, 2: 2, 3: 3}


def merge(master: DataFrame, using: DataFrame, kind: str, keys: list[str], keep: list | None = None, keepusing: list[str] | None = None, update: bool = False, replace: bool = False, generate: str | None = "_merge", check: list | None = None, verify: bool = True) -> DataFrame:
    if kind not in ("1:1", "m:1", "1:m"):
        raise DataError(198, f"{kind} is not supported")
    if verify:
        for side, one in ((master, kind[0] == "1"), (using, kind[2] == "1")):
            if one and not side.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise DataError(459, f"{' '.join(keys)} do not uniquely identify the rows")
    wanted = {NAMES[k] for k in keep} if keep else {1, 2, 3}
    extra = [c for c in (keepusing or using.columns) if c not in keys]
    shared = [c for c in extra if c in master.columns]
    only = [c for c in extra if c not in master.columns]
    u = using.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__u_{c}") for c in shared], *only, F.lit(True).alias("__in_u"))
    m = master.withColumn("__in_m", F.lit(True))
    on = None
    for k in keys:
        same = m[k].eqNullSafe(u[f"__k_{k}"])
        on = same if on is None else on & same
    code = F.when(F.col("__in_m") & F.col("__in_u"), 3).when(F.col("__in_m"), 1).otherwise(2).cast("double")
    if wanted == {1}:
        out = m.join(u, on, "left_anti").withColumns({"__in_u": F.lit(None).cast("boolean"), **{f"__k_{k}": F.lit(None).cast(dict(master.dtypes)[k]) for k in keys}, **{f"__u_{c}": F.lit(None).cast(dict(using.dtypes)[c]) for c in shared}, **{c: F.lit(None).cast(dict(using.dtypes)[c]) for c in only}})
    else:
        how = {frozenset({3}): "inner", frozenset({1, 3}): "left", frozenset({2, 3}): "right"}.get(frozenset(wanted), "full_outer")
        out = m.join(u, on, how)
    out = out.withColumn("__merge", code)
    if wanted == {2}:
        out = out.filter("__merge = 2")
    elif wanted == {1, 2}:
        out = out.filter("__merge <> 3")
    cols = []
    for c in master.columns:
        if c in keys:
            v = F.when(F.col("__in_m"), F.col(c)).otherwise(F.col(f"__k_{c}"))
        elif c in shared and replace:
            v = F.coalesce(F.col(f"__u_{c}"), F.col(c))
        elif c in shared and update:
            v = F.coalesce(F.col(c), F.col(f"__u_{c}"))
        else:
            v = F.col(c)
        cols.append(v.alias(c))
    out = out.select(*cols, *only, F.col("__merge").alias(generate or "__merge"))
    if check is not None:
        allowed = [float(NAMES[k]) for k in check]
        if not out.filter(~F.col(generate or "__merge").isin(allowed)).isEmpty():
            raise DataError(9, "merge results are not those asserted")
    return out if generate else out.drop("__merge")
