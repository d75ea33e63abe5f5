"""Vector expressions over ARRAY columns, in double whatever the input; a null vector gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a vector shorter than EPS stays as it is, in double."""
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the mean over each key's rows, by dimension, at length one. Means are combined before the shuffle."""
    means = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(key).agg(ordered.alias("mean")).select(key, unit(F.col("mean")).alias("centroid"))
