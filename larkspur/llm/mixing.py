"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, written

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating; null comes last
SHARE, MOST = 1.5, 2.0  # of all words; of a source's words


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also weight, target and rate = target / source_size.

    A level L gives each source min(most * size, L * weight) words; it is the level at which the targets make up
    ``share`` of all words, which is where resharing the excess by weight ends. A source is full if filling all sources
    up to its own full level takes no more than the budget. One row per source meets in one task, never documents.
    """
    every = Window.partitionBy()
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    filled = (
        ranked.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("lower", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("from_here", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("lower") + F.col("full_at") * F.col("from_here") <= F.col("budget"))
    )
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken: doc_id, size, source, source_size, target, copies, taken, and the columns of ``carry``.

    Within a source, documents stand in the order of their size, then of a hash of doc_id. Each expects ``rate`` copies;
    their prefix sum plus one offset of the source crosses ``copies`` whole numbers in each document. Neighbours have like
    sizes, so the words taken miss the target by about one large document. The order is cut into ranges that are counted
    and then numbered apart, so no source meets in one task.

    Null text has size 0, null source is a source of its own, and rows that repeat a doc_id are documents of their own.
    Equal input gives equal output; rows that are alike in doc_id, source and size may swap their copies.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select("doc_id", "source", *carry, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")).withColumn("key", key)
    sized = written(sized, "sizes")  # cutting ranges samples its input, which is to be the narrow rows and not the texts
    order = ["size", "key", F.col("doc_id").asc_nulls_first()]
    ranged = written(sized.repartitionByRange(n, F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()), "mixing")
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    rates = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = _with_rates(parts.select("source", "part", earlier.alias("before")), rates)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy(*order))
    placed = ranged.withColumn("rank_in_part", rank).alias("d").join(starts.alias("s"), (F.col("d.part") == F.col("s.part")) & F.col("d.source").eqNullSafe(F.col("s.source")))
    end = (F.col("before") + F.col("rank_in_part")).cast("double")
    copies = F.floor(end * F.col("rate") + F.col("offset")) - F.floor((end - 1) * F.col("rate") + F.col("offset"))
    return (
        placed.select("d.doc_id", "d.size", "d.source", *carry, "source_size", "target", "rate", "before", "rank_in_part")
        .withColumn("offset", offset)
        .select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), *carry)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def _with_rates(starts: DataFrame, rates: DataFrame) -> DataFrame:
    r = rates.select(F.col("source").alias("rated"), "source_size", "target", "rate")
    return starts.join(r, F.col("source").eqNullSafe(F.col("rated"))).drop("rated")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
f AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) + full_at * (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) <= budget AS is_full
  FROM c WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (
      (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER ()) END AS target
  FROM f),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.k, d.doc_id NULLS FIRST) AS DOUBLE) AS n,
         CAST(('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(floor(n * rate + u) - floor((n - 1) * rate + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM x
"""


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it, numbered by ``copy_no`` from 1. Rows are matched by number."""
    table = numbered(docs)
    plan = mix(table, **options, carry=("__ls_row",)).where("copies > 0").select("__ls_row", F.col("copies").alias("__ls_copies"))
    joined = table.join(plan, "__ls_row")
    return joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__ls_copies").cast("int")))).select(*[c for c in docs.columns if c != "copy_no"], "copy_no")
