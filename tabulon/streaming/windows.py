"""Tumbling windows over a stream or a batch, an addition to the statistics operators.

The batch ancestor is collapse over calendar buckets; over a stream the same plan runs with a
watermark, so that state is bounded by the lateness allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """start, the keys, n and total per window; ``late`` sets the watermark of a stream."""
    if late is not None:
        df = df.withWatermark(time, late)
    w = F.window(time, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
