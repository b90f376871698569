import random
import zlib

from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.streaming import frames


def test_chunk_bounds_do_not_change_frames(spark, tmp_path):
    rng = random.Random(1)
    contents = {"a": rng.randbytes(5000), "b": b"", "c": b"text " * 400}
    for batch in range(3):
        rows = []
        for k, data in contents.items():
            cut = len(data) * batch // 3, len(data) * (batch + 1) // 3
            mid = rng.randint(*cut)
            rows += [(k, 2 * batch, bytearray(data[cut[0] : mid]), False), (k, 2 * batch + 1, bytearray(data[mid : cut[1]]), batch == 2)]
        df = spark.createDataFrame(rows, "key string, seq bigint, data binary, last boolean")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    kind = "key string, seq bigint, data binary, last boolean"
    got = {}
    for batch in range(3):  # one file for each micro-batch, in order
        spark.read.parquet(f"{tmp_path}/in/{batch}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
        query = (
            frames.frame_stream(stream, 700)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/check")
            .start(f"{tmp_path}/out")
        )
        query.processAllAvailable()
        query.stop()
    out = spark.read.parquet(f"{tmp_path}/out").withColumn("plain", codec.decompress(F.col("payload")))
    for r in out.orderBy("key", "frame_id").collect():
        assert len(r.plain) == r.d_size
        got.setdefault(r.key, []).append(bytes(r.plain))
    want = {k: [v[i : i + 700] for i in range(0, len(v), 700)] or [b""] for k, v in contents.items()}
    assert {k: list(map(zlib.crc32, v)) for k, v in got.items()} == {k: list(map(zlib.crc32, v)) for k, v in want.items()}


def test_arriving_files(spark, tmp_path):
    for name in ("one.zst", "two.txt"):
        (tmp_path / name).write_bytes(b"data")
    query = frames.arriving_files(spark, str(tmp_path), ".zst").writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert [r.path.rsplit("/", 1)[1] for r in spark.table("arrived").collect()] == ["one.zst"]


def test_progress_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "Completed", 5), ("2024-01-01 00:00:50", "Failed", 0), ("2024-01-01 01:00:00", "Completed", 9)]
    df = spark.createDataFrame(rows, "ts string, status string, bytes bigint").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    query = frames.progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.n, r.failed, r.bytes) for r in spark.table("progress").collect()}
    assert got == {(2, 1, 5), (1, 0, 9)}
