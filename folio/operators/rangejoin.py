"""Point-in-interval joins without a nested loop: both sides meet in bins of the position axis.

Intervals are cut at bin borders, so that each row of an interval lies in one bin and a point in exactly one; the
equi-join on (key, bin) is then filtered exactly. A hot key is spread by its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "pos", start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """All (point, interval) with equal keys and start <= pos < end."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    last = F.floor((F.col(end) - 1) / width)
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    return p.join(i, [*keys, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def first_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: list[str], at: str = "pos", start: str = "start", end: str = "end", order: str = "idx", width: int = BIN) -> DataFrame:
    """Every point with the first interval that holds it, or null."""
    hit = point_in_interval(points.select(*keys, *point_id, at), intervals.select(*keys, start, end, order), keys, at, start, end, width)
    first = hit.groupBy(*keys, *point_id).agg(F.min(order).alias(order))
    return points.join(first, [*keys, *point_id], "left")


def label_intervals(intervals: DataFrame, points: DataFrame, keys: list[str], interval_id: list[str], at: str = "pos", start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Adds ``label``: 1 where some point lies in the interval."""
    hit = point_in_interval(points.select(*keys, at), intervals.select(*keys, *interval_id, start, end), keys, at, start, end, width)
    found = hit.select(*keys, *interval_id).distinct().withColumn("label", F.lit(1).cast("long"))
    return intervals.join(found, [*keys, *interval_id], "left").fillna(0, ["label"])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the right side's latest value at or before it, by one union and one window."""
    both = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(other).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", F.col("_v").alias(value))
