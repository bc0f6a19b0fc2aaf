"""Joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points and the half-open intervals they lie in: equal buckets of the given width, then the exact test.

    Choose the width near the usual length of an interval: an interval is repeated once a bucket it touches.
    """
    p = points.withColumn("_bucket", F.floor(F.col(value) / width))
    i = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, "_bucket").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bucket")
