"""Similarity and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom, vec

GALLERY_BLOCK = 1024  # identities of one broadcast row: a gallery is a closed registry, and larger ones come in blocks
MOST = 100_000  # identities that are sent to all tasks as rows
CELL = 512  # pixels of a grid cell


def blocks(gallery: DataFrame, block: int = GALLERY_BLOCK) -> DataFrame:
    """(members): rows of at most ``block`` identities as array<struct<gid, centroid>>."""
    return gallery.groupBy(F.floor(F.col("gid") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("gid", "centroid"))).alias("members")).select("members")


def similarities(rows: DataFrame, gallery: DataFrame, vector: str, name: str = "sims") -> DataFrame:
    """Every row against the gallery, the stated query set: one row per block with array<struct<cos, gid>>. Nothing of rows is shuffled.

    For galleries that all tasks may hold, as expressions; ``operators.gallery`` has matrix products, and a way for larger ones.
    """
    n = gallery.count()
    if n > MOST:
        raise ValueError(f"{n} identities are more than the {MOST} that are sent to all tasks: use operators.gallery")
    with_members = rows.join(F.broadcast(blocks(gallery)))
    sims = F.transform("members", lambda m: F.struct(vec.dot(F.col(vector), m["centroid"]).alias("cos"), m["gid"].alias("gid")))
    return with_members.withColumn(name, sims).drop("members")


def merged(sims: DataFrame, keys: list[str], name: str = "sims") -> DataFrame:
    """(keys, name): one row per key with the similarities of all blocks, by gid."""
    every = F.array_sort(F.transform(F.flatten(F.collect_list(name)), lambda s: F.struct(s["gid"].alias("gid"), s["cos"].alias("cos"))))
    return sims.groupBy(*keys).agg(every.alias(name))


def overlapping_pairs(rows: DataFrame, by: list[str], key: str, cell: int = CELL) -> DataFrame:
    """(by, a, b, iou) for pairs a < b of boxes in the same group that overlap.

    Boxes are dealt to the grid cells they touch and meet by group and cell, so a crowded group is spread over many keys;
    a pair is reported in the cell of its intersection's upper left corner alone, which needs no distinct.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = rows.select(*by, key, "x1", "y1", "x2", "y2").withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2"))
    side = lambda p: dealt.select(*by, "cx", "cy", *[F.col(c).alias(f"{p}{c}") for c in (key, "x1", "y1", "x2", "y2")])
    a, b = geom.box("a_"), geom.box("b_")
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    met = side("a_").join(side("b_"), [*by, "cx", "cy"]).where(
        (F.col(f"a_{key}") < F.col(f"b_{key}")) & (left < F.least(a[2], b[2])) & (top < F.least(a[3], b[3])) & (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy"))
    )
    return met.select(*by, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), geom.iou(a, b).alias("iou"))


def faces_of(persons: DataFrame, faces: DataFrame, by: list[str], key: str, cell: int = CELL) -> DataFrame:
    """(by, key, face, face_width): the widest face whose centre lies in the person's box, the smaller face key among equals; null if none."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    cx, cy = geom.centre(geom.box())
    points = faces.select(*by, F.col(key).alias("face"), cx.alias("px"), cy.alias("py"), (F.col("x2") - F.col("x1")).alias("face_width"))
    points = points.withColumns({"gx": F.floor(F.col("px") / cell), "gy": F.floor(F.col("py") / cell)})
    dealt = persons.select(*by, key, "x1", "y1", "x2", "y2").withColumn("gx", cells("x1", "x2")).withColumn("gy", cells("y1", "y2"))
    inside = dealt.join(points, [*by, "gx", "gy"]).where(geom.contains(geom.box(), F.col("px"), F.col("py")))
    best = inside.groupBy(*by, key).agg(F.max(F.struct("face_width", (-F.col("face")).alias("neg"))).alias("best"))
    return persons.select(*by, key).join(best, [*by, key], "left").select(*by, key, (-F.col("best.neg")).alias("face"), F.col("best.face_width").alias("face_width"))


def pool_cohesion(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean_cosine): the mean cosine of all pairs of a pool's unit vectors, null under two.

    The sum over pairs is half of |sum|^2 minus the sum of squares, so no pairs are made.
    """
    parts = vectors.select(key, F.posexplode(vec.unit(F.col(vector))).alias("i", "x"))
    sums = parts.groupBy(key, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return total.select(key, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))
