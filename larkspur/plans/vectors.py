"""Queries on vectors and the gallery, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import gallery, gates, matching, prefix
from ..sources import bridge
from ..sources.bridge import GALLERY_SQL

#: Thresholds for 64-dimensional fixture vectors.
FLOOR, MARGIN, POOL = 0.25, 0.05, 20


def q_a1_centroids(spark, sf_dir):
    return bridge.gallery(spark, sf_dir).select("gid", F.posexplode("centroid").alias("dim", "value")).select("gid", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def q_j9_similarity(spark, sf_dir):
    sims = gallery.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", ["vec_id"])
    return sims.select("vec_id", "gid", F.round("cos", 6).alias("cos"))


def _top(spark, sf_dir):
    return gallery.top_two(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", ["vec_id", "label"])


def q_p6_confidence_gate(spark, sf_dir):
    path = F.when(F.col("vec_id") % 2 == 0, "face").otherwise("osnet")
    via = gates.confirmed_via(path, F.col("assigned_sim"), F.col("second_best_sim"), F.col("n_identities"), FLOOR, FLOOR, MARGIN)
    return _top(spark, sf_dir).select(
        "vec_id", "gid", F.round("assigned_sim", 6).alias("assigned_sim"), F.round("second_best_sim", 6).alias("second_best_sim"), via.alias("confirmed_via"), (via != "none").alias("confirmed")
    )


def q_p14_ambiguity(spark, sf_dir):
    """Own centroid's cosine less the best other; vetoed under 0.03."""
    sims = matching.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding")
    pick = lambda own: F.array_max(F.transform(F.filter("sims", lambda s: (s["gid"] == F.col("label")) == own), lambda s: s["cos"]))
    parts = sims.select("vec_id", F.col("label").alias("gid"), pick(True).alias("own"), pick(False).alias("other"))
    best = parts.groupBy("vec_id", "gid").agg((F.max("own") - F.max("other")).alias("lead"))  # over the blocks of the gallery
    return best.select("vec_id", "gid", F.round("lead", 6).alias("lead"), (F.col("lead") < 0.03).alias("ambiguous"))


def q_a4_column_winner(spark, sf_dir):
    """The one vector with the strictly highest cosine of each identity; none on a tie."""
    best = gallery.column_winners(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding", "vec_id")
    return best.select("gid", F.round("best", 6).alias("best"), "winner")


def q_a7_pool_stats(spark, sf_dir):
    return matching.pool_cohesion(bridge.vectors(spark, sf_dir), "label", "embedding").select(F.col("label").alias("gid"), "n", F.round("mean_cosine", 6).alias("mean_cosine"))


def _pool(spark, sf_dir, most=POOL):
    """The first ``most`` vectors of each label: a pool is bounded by its cap."""
    v = bridge.vectors(spark, sf_dir)
    return v.withColumn("seq", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")).where(F.col("seq") <= most)


def q_a8_redundant_member(spark, sf_dir):
    """The member of each bounded pool that is nearest to another; the first of equals."""
    p = _pool(spark, sf_dir).select("label", "seq", vec.unit(F.col("embedding")).alias("u"))
    members = p.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("seq", "u"))).alias("ms"))
    one = p.join(members, "label").select("label", "seq", F.array_max(F.transform(F.filter("ms", lambda m: m["seq"] != F.col("seq")), lambda m: F.round(vec.dot(m["u"], F.col("u")), 9))).alias("near"))
    return one.groupBy("label").agg(F.max(F.struct("near", (-F.col("seq")).alias("neg"))).alias("b")).select(F.col("label").alias("gid"), (-F.col("b.neg")).alias("seq"), F.round("b.near", 6).alias("nearest"))


def _pool_sims(spark, sf_dir):
    pools = _pool(spark, sf_dir, 10).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("seq", vec.unit(F.col("embedding")).alias("u")))).alias("ms"))
    return bridge.vectors(spark, sf_dir).join(pools, "label").select("vec_id", "label", "embedding", F.transform("ms", lambda m: vec.dot(m["u"], F.col("embedding"))).alias("sims"))


def q_t2_pool_top_k(spark, sf_dir):
    top = F.slice(F.sort_array("sims", asc=False), 1, 3)
    return _pool_sims(spark, sf_dir).select("vec_id", *[F.round(F.get(top, F.lit(i)), 6).alias(f"sim_{i + 1}") for i in range(3)])


def q_f10_augmented(spark, sf_dir):
    """The better of the centroid's and the pool's similarity, and whether the pool strictly won."""
    g = bridge.gallery(spark, sf_dir).select(F.col("gid").alias("label"), "centroid")
    rows = _pool_sims(spark, sf_dir).join(g, "label")
    sim, won = gates.augmented(vec.dot(F.col("embedding"), F.col("centroid")), F.array_max("sims"))
    return rows.select("vec_id", F.round(sim, 6).alias("sim"), won.alias("warm_won"))


def q_a2_running_mean(spark, sf_dir):
    """Cosine of each label's weighted running mean with its centroid."""
    v = bridge.vectors(spark, sf_dir)
    means = prefix.running_means(v, ["label"], "vec_id", "embedding", (F.col("vec_id") % 7 + 1) / 7.0)
    g = bridge.gallery(spark, sf_dir).select(F.col("gid").alias("label"), "centroid")
    return means.join(g, "label").select("vec_id", F.col("label").alias("gid"), F.round(vec.dot(F.col("running"), F.col("centroid")), 6).alias("cos"))


def q_f33_cosine_map(spark, sf_dir):
    sims = matching.merged(matching.similarities(bridge.vectors(spark, sf_dir), bridge.gallery(spark, sf_dir), "embedding"), ["vec_id"])
    entry = lambda s: F.struct(s["gid"].alias("gid"), (s["cos"] >= FLOOR).alias("ok"))
    return sims.select("vec_id", F.to_json(F.map_from_entries(F.transform(F.array_sort(F.transform("sims", entry)), lambda s: F.struct(s["gid"].cast("string"), s["ok"])))).alias("over_floor"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_TOP = "tp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, gid) AS rn, count(*) OVER (PARTITION BY vec_id) AS n FROM sims)"
_POOL = """ po AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq FROM embeddings),
 pu AS (SELECT *, e AS raw, sqrt(list_dot_product(e, e)) AS len FROM po)"""
_WARM = f"""{_POOL}, ps AS (SELECT v.vec_id, v.label, list_dot_product(p.e, v.e) / p.len AS s FROM pu v JOIN pu p ON v.label = p.label AND p.seq <= 10)"""

SQL = {
    "q_a1_centroids": f"WITH {GALLERY_SQL} SELECT gid, CAST(i - 1 AS BIGINT) AS dim, round(v, 6) AS value FROM (SELECT gid, generate_subscripts(centroid, 1) AS i, unnest(centroid) AS v FROM cen)",
    "q_j9_similarity": f"WITH {GALLERY_SQL} SELECT vec_id, gid, round(cos, 6) AS cos FROM sims",
    "q_p6_confidence_gate": f"""WITH {GALLERY_SQL}, {_TOP},
 t AS (SELECT vec_id, max(gid) FILTER (rn = 1) AS gid, max(cos) FILTER (rn = 1) AS a, max(cos) FILTER (rn = 2) AS b, max(n) AS n FROM tp GROUP BY vec_id),
 g AS (SELECT *, CASE WHEN vec_id % 2 = 0 AND a >= {FLOOR} THEN 'face' WHEN vec_id % 2 <> 0 AND a >= {FLOOR} AND (n <= 1 OR b IS NULL OR a - b >= {MARGIN}) THEN 'osnet' ELSE 'none' END AS confirmed_via FROM t)
SELECT vec_id, gid, round(a, 6) AS assigned_sim, round(b, 6) AS second_best_sim, confirmed_via, confirmed_via <> 'none' AS confirmed FROM g""",
    "q_p14_ambiguity": f"""WITH {GALLERY_SQL}, d AS (SELECT vec_id, label, max(cos) FILTER (gid = label) - max(cos) FILTER (gid <> label) AS l FROM sims GROUP BY vec_id, label)
SELECT vec_id, label AS gid, round(l, 6) AS lead, l < 0.03 AS ambiguous FROM d""",
    "q_a4_column_winner": f"""WITH {GALLERY_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY gid ORDER BY cos DESC) AS rk FROM sims)
SELECT gid, round(max(cos), 6) AS best, CASE WHEN count(*) = 1 THEN max(vec_id) END AS winner FROM r WHERE rk = 1 GROUP BY gid""",
    "q_a7_pool_stats": f"""WITH {_POOL}, c AS (SELECT label AS gid, count(*) AS n FROM pu GROUP BY label),
 p AS (SELECT a.label AS gid, avg(list_dot_product(a.e, b.e) / (a.len * b.len)) AS m FROM pu a JOIN pu b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)
SELECT gid, n, round(m, 6) AS mean_cosine FROM c LEFT JOIN p USING (gid)""",
    "q_a8_redundant_member": f"""WITH {_POOL}, p AS (SELECT a.label AS gid, a.seq, max(round(list_dot_product(a.e, b.e) / (a.len * b.len), 9)) AS near
   FROM pu a JOIN pu b ON a.label = b.label AND a.seq <> b.seq WHERE a.seq <= {POOL} AND b.seq <= {POOL} GROUP BY a.label, a.seq)
SELECT gid, seq, round(near, 6) AS nearest FROM p QUALIFY row_number() OVER (PARTITION BY gid ORDER BY near DESC, seq) = 1""",
    "q_t2_pool_top_k": f"""WITH {_WARM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS k FROM ps)
SELECT vec_id, {", ".join(f"round(max(s) FILTER (k = {i}), 6) AS sim_{i}" for i in (1, 2, 3))} FROM r GROUP BY vec_id""",
    "q_f10_augmented": f"""WITH {GALLERY_SQL}, {_WARM}, w AS (SELECT vec_id, max(s) AS warm FROM ps GROUP BY vec_id), k AS (SELECT vec_id, cos FROM sims WHERE gid = label)
SELECT vec_id, round(CASE WHEN warm > cos THEN warm ELSE cos END, 6) AS sim, warm > cos AS warm_won FROM w JOIN k USING (vec_id)""",
    "q_a2_running_mean": f"""WITH {GALLERY_SQL}, r AS (SELECT vec_id, label, i, sum(v * CAST(vec_id % 7 + 1 AS DOUBLE) / 7) OVER (PARTITION BY label, i ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS s FROM ex),
 g AS (SELECT gid, generate_subscripts(centroid, 1) AS i, unnest(centroid) AS c FROM cen)
SELECT vec_id, label AS gid, round(sum(s * c) / sqrt(sum(s * s)), 6) AS cos FROM r JOIN g ON r.label = g.gid AND r.i = g.i GROUP BY vec_id, label""",
    "q_f33_cosine_map": f"""WITH {GALLERY_SQL} SELECT vec_id, '{{' || string_agg('"' || gid || '":' || CASE WHEN cos >= {FLOOR} THEN 'true' ELSE 'false' END, ',' ORDER BY gid) || '}}' AS over_floor FROM sims GROUP BY vec_id""",
}
