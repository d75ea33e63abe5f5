"""Ordered-sequence operators: chunks, segments, windows, carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from . import intervals


def chunk_members(frames: DataFrame, key: str, size: int = 25, overlap: int = 4) -> DataFrame:
    """(key, chunk_id, pos_in_chunk, frame_idx): overlapping chunks of each key's frames 0..n-1, from frames(key, n).

    Chunk j holds [j * (size - overlap), ... + size); a tail is emitted only if it is the first chunk or holds more than the overlap.
    """
    step = size - overlap
    chunks = frames.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("chunk_id"))
    kept = chunks.where((F.col("chunk_id") == 0) | (F.col("n") - F.col("chunk_id") * step > overlap))
    first, last = F.col("chunk_id") * step, F.least(F.col("n") - 1, F.col("chunk_id") * step + size - 1)
    return kept.select(key, "chunk_id", F.posexplode(F.sequence(first, last)).alias("pos_in_chunk", "frame_idx"))


def first_chunk_only(members: DataFrame, key: str, size: int = 25, overlap: int = 4) -> DataFrame:
    """Each frame once, from the first chunk that holds it: all of chunk 0 and what follows the overlap in later ones."""
    return members.where((F.col("chunk_id") == 0) | (F.col("pos_in_chunk") >= overlap))


def segmented(rows: DataFrame, keys: list[str], max_bridge: int, order: str = "frame_idx") -> DataFrame:
    """Adds segment (from 0) and pos in it: a gap of more than max_bridge missing frames starts a new segment."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > 1 + max_bridge).cast("long"), F.lit(0).cast("long"))
    numbered = rows.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w)).drop("__new")
    return numbered.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys, "segment").orderBy(order)) - 1).cast("long"))


def windows(n: Column, length: int = 49, overlap: int = 13, least: int = 5) -> Column:
    """array<struct<start, end>> of positions that windows of 4k + 1 frames take in a segment of n.

    Candidates start every ``length - overlap`` positions; the first that is too short or ends no later than the one before
    it, or follows one that reached the end, stops the list. The last window slides back to
    end at n - 1 if it still starts after the window two before it, so that no frame is in more than two windows.
    """
    stride = max(1, length - overlap)
    start = lambda j: j * stride
    end = lambda j: start(j) + geom.window_length(F.least(F.lit(length).cast("long"), n - start(j))) - 1
    stop = lambda j: (end(j) - start(j) + 1 < least) | ((j > 0) & ((end(j) <= end(j - 1)) | (end(j - 1) >= n - 1)))
    index = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / stride)))
    fails = F.filter(index, stop)
    taken = F.transform(F.slice(index, 1, F.when(F.size(fails) > 0, fails[0]).otherwise(F.size(index)).cast("int")), lambda j: F.struct(start(j).alias("start"), end(j).alias("end")))
    last, before = F.element_at(taken, -1), F.when(F.size(taken) > 2, F.element_at(taken, -3)["end"]).otherwise(F.lit(-1).cast("long"))
    back = n - 1 - (last["end"] - last["start"])
    slid = F.concat(F.slice(taken, 1, F.size(taken) - 1), F.array(F.struct(back.alias("start"), (n - 1).alias("end"))))
    return F.when((F.size(taken) == 0) | (n <= 0), F.array().cast("array<struct<start:bigint,end:bigint>>")).when((last["end"] < n - 1) & (back > before), slid).otherwise(taken)


def planned(segments: DataFrame, keys: list[str], length: int = 49, overlap: int = 13) -> DataFrame:
    """(keys, segment, window_idx, start_pos, end_pos) from segmented rows; sizes are combined before the shuffle."""
    sizes = segments.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(*keys, "segment", F.posexplode(windows(F.col("n"), length, overlap)).alias("window_idx", "w")).select(*keys, "segment", F.col("window_idx").cast("long").alias("window_idx"), F.col("w.start").alias("start_pos"), F.col("w.end").alias("end_pos"))


def window_rows(segments: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """The segmented rows of each window, at most two for each row."""
    slots = plan.select(*keys, "segment", "window_idx", "start_pos", "end_pos")
    return intervals.points_in(segments, slots, [*keys, "segment"], "pos", "start_pos", "end_pos")


def crop_boxes(rows: DataFrame, keys: list[str], pad: float = 0.10, height: float = 832.0) -> DataFrame:
    """(keys, x0, y0, x1, y1, w, h): the padded union of boxes and the canvas of this height, sides multiples of 16."""
    u = rows.groupBy(*keys).agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    dx, dy = (F.col("c") - F.col("a")) * pad, (F.col("d") - F.col("b")) * pad
    boxed = u.select(*keys, (F.col("a") - dx).alias("x0"), (F.col("b") - dy).alias("y0"), (F.col("c") + dx).alias("x1"), (F.col("d") + dy).alias("y1"))
    ratio = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    return boxed.withColumns({"w": geom.round16(ratio * height), "h": geom.round16(F.lit(height))})


def carried_forward(rows: DataFrame, by: list[str], columns: list[str], last_frame: Column, most: int = 3, factor: float = 0.9) -> DataFrame:
    """Ghosts for frames without rows: the last real frame's rows again, ``most`` frames on at most, with score * factor.

    ``last_frame`` is where the group ends. Only real frames are listed; ghosts come from the gap to the next one.
    """
    real = rows.groupBy(*by, "frame_idx").agg(F.max(last_frame).alias("__end"))
    following = F.lead("frame_idx").over(Window.partitionBy(*by).orderBy("frame_idx"))
    stop = F.least(F.col("frame_idx") + most, F.coalesce(F.col("__next") - 1, F.col("__end")), F.col("__end"))
    gaps = real.withColumn("__next", following).withColumn("__stop", stop).where("__stop > frame_idx")
    ghosts = gaps.select(*by, F.col("frame_idx").alias("from_frame"), F.explode(F.sequence(F.col("frame_idx") + 1, F.col("__stop"))).alias("ghost_frame"))
    source = rows.select(*by, F.col("frame_idx").alias("from_frame"), "score", *columns)
    return ghosts.join(source, [*by, "from_frame"]).select(*by, F.col("ghost_frame").alias("frame_idx"), "from_frame", *columns, (F.col("score") * factor).alias("score"))


def sampled(rows: DataFrame, keys: list[str], ts: str, step: float, start: float = 0.0) -> DataFrame:
    """The rows that "emit if ts >= next, then next += step" emits, in order of ts.

    After i rows with allowance a_i = floor((ts_i - start) / step) + 1, the rule has emitted m_i = min(m_{i-1} + 1, a_i),
    which is i plus the running minimum of a_j - j, at most i: a window, no fold.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    a = F.floor((F.col(ts) - F.lit(start)) / F.lit(step)) + 1
    i = F.row_number().over(w)
    emitted = rows.where(F.col(ts) >= start).withColumn("__slack", a - i).withColumn("__m", i + F.least(F.lit(0), F.min("__slack").over(upto)))
    return emitted.withColumn("__before", F.coalesce(F.lag("__m").over(w), F.lit(0))).where("__m > __before").drop("__m", "__slack", "__before")
