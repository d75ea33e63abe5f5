"""Detections and a gallery from the star-schema tables, for queries and tests; the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

FRAME_H = 1000  # pixels of a frame in the bridge views


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label"))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, centroid)"""
    return vec.centroids(vectors(spark, sf_dir).withColumnRenamed("label", "gid"), "gid", "embedding")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour: the first event makes the box, its score, and the vector it shows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_vectors"))
    hour = (F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    first = events.select("user_id", hour.alias("frame_idx"), "event_id", k.alias("k")).groupBy("user_id", "frame_idx").agg(F.min(F.struct("event_id", "k")).alias("e"))
    placed = first.select(
        F.col("e.event_id").alias("event_id"), (F.col("user_id") % 10).alias("video_id"), F.floor(F.col("user_id") / 10).alias("obj_id"), "frame_idx", F.col("e.k").alias("k")
    )
    boxed = placed.withColumns({"x1": (F.col("obj_id") * 97 + F.col("frame_idx") * 3) % 1500, "y1": (F.col("obj_id") * 61 + F.col("frame_idx")) % 700})
    return (
        boxed.withColumns({"x2": F.col("x1") + 60 + F.col("k"), "y2": F.col("y1") + 150 + 2 * F.col("k"), "score": (F.col("k") + 1) / 100.0})
        .withColumn("mask_area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * (F.col("k") % 4 + 1) / 4.0)
        .withColumn("mask_source", F.when(F.col("k") % 3 == 0, "cached").otherwise("detection"))
        .join(F.broadcast(n))  # one row
        .withColumn("vec_id", F.col("event_id") % F.col("n_vectors"))
        .drop("n_vectors")
    )


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with gid, the label of the vector they show."""
    return detections(spark, sf_dir).join(vectors(spark, sf_dir).select("vec_id", F.col("label").alias("gid")), "vec_id")


GALLERY_SQL = """
 ex AS (SELECT vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 mn AS (SELECT label AS gid, i, avg(v) AS m FROM ex GROUP BY label, i),
 cen AS (SELECT gid, list(m / n ORDER BY i) AS centroid FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY gid)) AS n FROM mn) GROUP BY gid),
 sims AS (SELECT vec_id, CAST(label AS BIGINT) AS label, gid, list_dot_product(CAST(embedding AS DOUBLE[]), centroid) AS cos FROM embeddings, cen)"""

DET_SQL = """
 ev AS (SELECT event_id, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS frame_idx,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
 fi AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, frame_idx ORDER BY event_id) = 1),
 bx AS (SELECT event_id, user_id % 10 AS video_id, user_id // 10 AS obj_id, frame_idx, k,
               ((user_id // 10) * 97 + frame_idx * 3) % 1500 AS x1, ((user_id // 10) * 61 + frame_idx) % 700 AS y1 FROM fi),
 det AS (SELECT *, x1 + 60 + k AS x2, y1 + 150 + 2 * k AS y2, CAST(k + 1 AS DOUBLE) / 100 AS score,
               CAST((60 + k) * (150 + 2 * k) * (k % 4 + 1) AS DOUBLE) / 4 AS mask_area,
               CASE WHEN k % 3 = 0 THEN 'cached' ELSE 'detection' END AS mask_source,
               event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM bx),
 mat AS (SELECT det.*, CAST(label AS BIGINT) AS gid FROM det JOIN embeddings USING (vec_id))"""
