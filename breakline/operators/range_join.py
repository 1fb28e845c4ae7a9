"""Joins of points with intervals by levelled bins, so that Spark has an equality to shuffle on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bin is so many times as wide as one of the level below; a power of two.
GROWTH, BITS = 4, 2


def level(length: Column, width: int) -> Column:
    """The lowest level whose bins, `width` times a power of GROWTH, are at least `length` wide."""
    over = F.floor((length - 1) / F.lit(width)).cast("long")
    return F.when(over <= 0, 0).otherwise(F.ceil(F.length(F.bin(over)) / BITS)).cast("int")


def bin_at(position: Column, at: Column, width: int) -> Column:
    return F.floor(position / (F.lit(float(width)) * F.pow(F.lit(float(GROWTH)), at))).cast("long")


def binned_intervals(intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Intervals with low <= high as one or two rows: `_level` is by length, `_bin` holds an end of it."""
    sized = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", level(F.col(high) - F.col(low) + 1, width))
    ends = F.array_distinct(F.array(bin_at(F.col(low), F.col("_level"), width), bin_at(F.col(high), F.col("_level"), width)))
    return sized.withColumn("_bin", F.explode(ends))


def range_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, on: list[str], width: int, how: str = "inner") -> DataFrame:
    """Rows of `points` whose `point` lies in [low, high] of a row of `intervals` with equal `on`.

    An interval lies in the one or two bins that hold its ends, on the level of its length, and a point
    looks up one bin on each level that occurs (a handful: they grow by GROWTH); so no interval is repeated
    for its length, and a point meets only intervals that are at least a part of its bin long. A
    pair is found once. Intervals with low > high, and nulls, meet nothing. `how` is inner, left_semi or
    left_anti. For a hot bin the adaptive skew join splits the shuffle. `intervals` is read twice.
    """
    if how != "inner":
        asked = points.select(*on, point).distinct()
        hit = range_join(asked, point, intervals.select(*on, low, high), low, high, on, width).select(*on, point).distinct()
        return points.join(hit, [*on, point], how)
    i = binned_intervals(intervals, low, high, width)
    levels = i.agg(F.collect_set("_level")).scalar()
    p = points.withColumn("_level", F.explode(levels)).withColumn("_bin", bin_at(F.col(point), F.col("_level"), width))
    keys = [*on, "_level", "_bin"]
    met = i.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test: Column = F.col(point).between(F.col(low), F.col(high))
    for k in keys:
        test = (F.col(k) == F.col(f"_r_{k}")) & test
    return p.join(met, test).drop("_level", "_bin", *(f"_r_{k}" for k in keys))
