from larkspur.operators.resolver import resolve
from larkspur.plans.stateful import _samples
from larkspur.sources import bridge
from larkspur.streaming.resolver import resolve_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = _samples(spark, SF).where("video_id < 4")
    gallery = bridge.gallery(spark, SF)
    for i, part in enumerate(("frame_idx < 300", "frame_idx >= 300")):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = resolve_stream(stream, gallery).writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    key = lambda r: (r.video_id, r.frame_idx, r.obj_id, r.gid)
    assert sorted(map(key, spark.table("resolved").collect())) == sorted(map(key, resolve(rows, gallery).collect()))
