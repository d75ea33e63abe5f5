"""What the operators share: tables in the shared folder, fixed-size bitmap filters, row filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts define it.
WORD = r"[^\x20\x09-\x0D]+"

#: log2 of the bits of a bitmap filter: 2**27 bits are 16 MB however large the input is.
FILTER_BITS = 27
_BUCKET = 15  # log2 of the bits that Spark's bitmap functions keep in one row


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. One of our own only where none is set and Spark runs in this process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/larkspur-{sc.applicationId}"


@dataclass
class Scratch:
    """Tables and broadcasts that some work has made beside its result."""

    tables: list[str] = field(default_factory=list)
    broadcasts: list[Broadcast] = field(default_factory=list)


_SCOPES = [Scratch()]


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Collects what is made inside, for release() once no DataFrame needs it any more."""
    _SCOPES.append(Scratch())
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors, fixes what is not deterministic."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCOPES[-1].tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a value whose size has a bound."""
    _SCOPES[-1].broadcasts.append(spark.sparkContext.broadcast(value))
    return _SCOPES[-1].broadcasts[-1]


def release(spark: SparkSession, made: Scratch | None = None) -> None:
    """Delete the tables and broadcasts of a scope, or of all work outside scopes."""
    made = _SCOPES[0] if made is None else made
    for table in made.tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for b in made.broadcasts:
        b.destroy()
    made.tables.clear()
    made.broadcasts.clear()


def bitmap(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """(__ls_bucket, __ls_bits): a bitmap with the slot of each key set, of 2**bits bits at most, whatever the number of keys."""
    slot = F.pmod(key, F.lit(1 << bits))
    return keys.groupBy(F.shiftright(slot, _BUCKET).alias("__ls_bucket")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << _BUCKET) - 1))).alias("__ls_bits"))


def maybe_in(df: DataFrame, key: Column, found: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``__ls_hit``: false only if the bitmap surely lacks the key. A full bitmap costs time and nothing else."""
    slot = F.pmod(key, F.lit(1 << bits))
    at = slot.bitwiseAND(F.lit((1 << _BUCKET) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__ls_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr("1")
    for i in range(1, 8):
        mask = F.when(at % 8 == i, F.lit(1 << i)).otherwise(mask)
    joined = df.withColumn("__ls_bucket", F.shiftright(slot, _BUCKET)).join(F.broadcast(found), "__ls_bucket", "left")
    return joined.withColumn("__ls_hit", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("__ls_bucket", "__ls_bits")


def bitmap_array(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap as bytes, lowest bit first, for Python tasks: at most 2**(bits-3) bytes pass through the driver."""
    out = np.zeros(1 << max(bits - 3, 0), np.uint8)
    size = 1 << (_BUCKET - 3)
    for row in found.toLocalIterator():
        part = np.frombuffer(row["__ls_bits"], np.uint8)
        at = row["__ls_bucket"] * size
        out[at : at + size] = part[: len(out) - at]
    return out


def has_bit(bitmap_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each signed or unsigned 64-bit key is in a bitmap_array."""
    slot = keys.astype(np.uint64) & np.uint64(len(bitmap_bytes) * 8 - 1)
    return (bitmap_bytes[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def numbered(docs: DataFrame) -> DataFrame:
    """docs and ``__ls_row``, a number of the row. Written, so the numbers hold: ids may be null or repeat, rows may be alike."""
    return written(docs.withColumn("__ls_row", F.monotonically_increasing_id()), "rows")


def all_but_first(members: DataFrame) -> DataFrame:
    """(row, group, at) -> (__ls_dropped): all rows but the first of their group by ``at``, a struct whose ``row`` tells rows apart.

    The first are found by a partial aggregate and taken out by row, so a large group meets in no task.
    """
    first = members.groupBy("group").agg(F.min("at").alias("at")).select("at.row")
    return members.select("row").join(first, "row", "left_anti").select(F.col("row").alias("__ls_dropped"))


def without(table: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a numbered table whose number is not in dropped(__ls_dropped). Rows that the bitmap surely lacks skip the shuffle."""
    columns = [c for c in table.columns if c != "__ls_row"]
    dropped = written(dropped, "dropped")
    marked = maybe_in(table, F.xxhash64("__ls_row"), bitmap(dropped, F.xxhash64("__ls_dropped")))
    sure = marked.where(~F.col("__ls_hit")).select(columns)
    rest = marked.where("__ls_hit").join(dropped, F.col("__ls_row") == F.col("__ls_dropped"), "left_anti").select(columns)
    return sure.unionByName(rest)
