"""Records that people and other programs read: operator proposals and telemetry, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPOSAL = "struct<objects:array<struct<obj_id:bigint,bbox:array<double>,proposed_gid:bigint,operator_gid:bigint>>>"


def proposals(tracks: DataFrame) -> DataFrame:
    """(video_id, frame_idx, proposal): a JSON text for each frame with the identity proposed for each object; -1 for none.

    A frame's objects are one row; they are bounded by what a frame can show. An operator edits operator_gid.
    """
    gid = F.coalesce(F.col("gid"), F.lit(-1).cast("long"))
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    one = F.struct("obj_id", box.alias("bbox"), gid.alias("proposed_gid"), gid.alias("operator_gid"))
    objects = F.array_sort(F.collect_list(one))
    return tracks.groupBy("video_id", "frame_idx").agg(F.to_json(F.struct(objects.alias("objects")), {"ignoreNullFields": "false"}).alias("proposal"))


def operator_ids(edited: DataFrame) -> DataFrame:
    """(video_id, frame_idx, obj_id, gid) from proposal texts; a negative operator_gid is null, left to the resolver."""
    read = F.from_json("proposal", PROPOSAL)
    o = edited.select("video_id", "frame_idx", F.explode(read["objects"]).alias("o"))
    return o.select("video_id", "frame_idx", "o.obj_id", F.when(F.col("o.operator_gid") >= 0, F.col("o.operator_gid")).alias("gid"))


def telemetry(**kinds: DataFrame) -> DataFrame:
    """All rows of the frames given, with their kind; columns that a kind lacks are null."""
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("kind"), "*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def write_log(log: DataFrame, folder: str | None) -> None:
    """JSON lines, a folder for each kind; nothing without a folder."""
    if folder:
        log.write.mode("append").partitionBy("kind").json(folder)


def per_id(gid: Column, value: Column) -> Column:
    """An aggregate: value by gid as a map, identities in order. The gallery bounds its size."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(gid, value))))
