"""Conditions that end a job, as part of its plan: rows that must not be there, and tables that must not be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def _with_none(df: DataFrame, watched: DataFrame, error: Column) -> DataFrame:
    """df as it is; the first ``error`` of the rows of watched is raised, if one isn't null. watched adds no rows.

    Errors meet in an aggregate first: a filter that raises could otherwise be moved to before what makes the rows of watched.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    found = watched.agg(F.min(error).alias("__error"))
    return df.unionByName(found.where(F.when(F.col("__error").isNotNull(), F.raise_error(F.col("__error"))).otherwise(F.lit(None)).isNotNull()).select(*empty))


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """df; the job fails with the message if it has no rows. Rows are counted by task before they meet."""
    return _with_none(df, df.agg(F.count(F.lit(1)).alias("n")), F.when(F.col("n") == 0, F.lit(message)))


def none_of(df: DataFrame, bad: DataFrame, message: Column) -> DataFrame:
    """df; the job fails with the message of a row of bad if there is one."""
    return _with_none(df, bad, message)


def gallery(folders: DataFrame, images: DataFrame, faces: DataFrame) -> DataFrame:
    """(gid, folder, n_images, n_faces): identities numbered from 0 by folder name, from folders(folder), images(folder, path) and faces(path).

    The job fails if there are no folders, if one has no image, or if no image of one shows a face. Identities are numbered
    by counts of whole ranges of names, so only one number a range meets in a task.
    """
    seen = faces.groupBy("path").agg(F.count(F.lit(1)).alias("faces"))
    found = images.join(seen, "path", "left").groupBy("folder").agg(F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum("faces"), F.lit(0)).alias("n_faces"))
    every = folders.select("folder").distinct().join(found, "folder", "left")
    what = F.when(F.col("n_images").isNull(), "no images in ").when(F.col("n_faces") == 0, "no face in any image of ")
    numbered = _numbered(not_empty(every, "the gallery has no folders of identities"), "folder")
    failing = F.when(what.isNotNull(), F.raise_error(F.concat(what, F.col("folder"))).cast("long"))
    return numbered.select(F.coalesce(failing, "gid").alias("gid"), "folder", F.col("n_images"), F.col("n_faces"))


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with gid, the number of rows that come before by a column without equals."""
    cut = scratch.written(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return cut.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("gid", (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__before")


def overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """rows(keys, gid, ...) with the gid that overrides(keys, set_gid) say, and ``operator_assigned``; a null set_gid changes nothing.

    The job fails if an override names an object that has no rows, if an object has two, or, given known(gid), an identity
    that isn't known.
    """
    lost = overrides.join(rows.select(*keys).distinct(), keys, "left_anti")
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    twice = overrides.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rows.join(overrides, keys, "left").select(*[F.coalesce("set_gid", "gid").alias("gid") if c == "gid" else c for c in rows.columns], F.col("set_gid").isNotNull().alias("operator_assigned"))
    out = none_of(out, lost, F.concat(F.lit("an override names an unknown object: "), name))
    out = none_of(out, twice, F.concat(F.lit("two overrides of one object: "), name))
    if known is not None:
        strange = overrides.where("set_gid is not null").join(known.select(F.col("gid").alias("set_gid")), "set_gid", "left_anti")
        out = none_of(out, strange, F.concat(F.lit("an override names an unknown identity: "), F.col("set_gid").cast("string")))
    return out
