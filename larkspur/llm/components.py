"""Connected components of a link table by local contraction, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): one row per node that has a link; nodes have one root if and only if links connect them.

    In each round every node joins the neighbour (or itself) that comes first in an order hashed anew for the round, and
    links are renamed and made distinct. Each round leaves a constant fraction of the nodes with links, so the rounds grow
    with the logarithm, whatever the shape; minima are combined before they are shuffled, and both sides of each join are
    written tables, so skewed nodes can be split. Null links and links of a node to itself count for nothing but the node.
    """
    edges = written(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    live, turn = edges.where("a <> b"), 0
    while not live.isEmpty():
        turn += 1
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("p"), c.alias("v"))
        both = live.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("w")))
        best = both.groupBy("u").agg(F.min(rank(F.col("w"))).alias("m"))
        moves = written(best.select("u", F.least("m", rank(F.col("u")))["v"].alias("to")), "moves")
        labels = written(labels.join(moves, labels["root"] == moves["u"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        m1, m2 = moves.select(F.col("u").alias("a"), F.col("to").alias("ta")), moves.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        renamed = live.join(m1, "a").join(m2, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        live = written(renamed, "links")
    return labels
