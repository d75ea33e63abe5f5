"""Joins of intervals of whole numbers, ends included, by bins: no row for each place that an interval covers.

An interval is dealt to the bins it touches, so rows grow with length over ``width``. Pairs meet by key and bin; a pair of
intervals counts in the bin where what they share begins, and so once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("long")


def _dealt(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    some = intervals.where(F.col(start) <= F.col(end))
    return some.withColumn("__bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point with each interval of its key that holds it: all columns of both."""
    here = points.withColumn("__bin", _bin(F.col(at), width))
    return here.join(_dealt(intervals, start, end, width), [*keys, "__bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: tuple[str, str], end: tuple[str, str], width: int = 64) -> DataFrame:
    """Pairs of intervals of a key that share a place, once each: all columns of both, and ``from`` and ``to`` of what they share."""
    met = _dealt(a, start[0], end[0], width).join(_dealt(b, start[1], end[1], width), [*keys, "__bin"])
    shared = met.withColumns({"from": F.greatest(*start), "to": F.least(*end)})
    return shared.where((F.col("from") <= F.col("to")) & (_bin(F.col("from"), width) == F.col("__bin"))).drop("__bin")
