"""Seekable files: frames with a seek table, read by range."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.codec import compress, decompress, zstd_stream_codec
from cairn.operators.seek import frame_range, parse, seek_table, serialize

#: Most bytes of a frame, and what the input is consumed in.
MOST_FRAME, CHUNK = 0x40000000, 128 << 10


def joined_bytes(part: str, order: str) -> Column:
    return F.expr(f"listagg({part}) WITHIN GROUP (ORDER BY {order})")


def fixed_frames(files: DataFrame, key: str, data: Column, frame_size: int, level: int = 3, checksum: bool = True) -> DataFrame:
    """``(key, frame_id, d_size, payload)``: frames of ``frame_size`` bytes of content each.

    Frames are cut by expressions and compressed apart, so one large file is spread over tasks.
    """
    n = F.greatest(F.ceil(F.octet_length(data) / frame_size), F.lit(1)).cast("int")
    each = files.select(key, data.alias("__data"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_id"))
    part = F.substring("__data", F.col("frame_id") * frame_size + 1, F.lit(frame_size))
    cut = each.select(key, F.col("frame_id").cast("bigint"), F.octet_length(part).cast("bigint").alias("d_size"), part.alias("part"))
    return cut.select(key, "frame_id", "d_size", compress(F.col("part"), "zstd-stream", level=level, checksum=checksum).alias("payload"))


def grown_frames(data: bytes, frame_size: int, level: int, checksum: bool, most: int = MOST_FRAME) -> list[tuple[bytes, int]]:
    """Frames that end once their compressed size reaches ``frame_size``: after each chunk of input
    the frame so far is encoded and measured, so each depends on the one before."""
    codec, out, pending = zstd_stream_codec(level, checksum), [], b""
    at = 0
    while at < len(data):
        take = min(CHUNK - at % CHUNK, len(data) - at, most - len(pending))
        pending += data[at : at + take]
        at += take
        packed = codec(pending)
        if len(packed) >= frame_size or len(pending) >= most:
            out.append((packed, len(pending)))
            pending = b""
    if pending or not out:
        out.append((codec(pending), len(pending)))
    return out


def measured_frames(files: DataFrame, key: str, data: Column, frame_size: int, level: int = 3, checksum: bool = True) -> DataFrame:
    """Frames of about ``frame_size`` compressed bytes; each file is encoded by one task."""
    kind = T.ArrayType(T.StructType().add("payload", T.BinaryType()).add("d_size", T.LongType()))

    def run(col: pa.Array) -> pa.Array:
        rows = [
            None if v is None else [{"payload": p, "d_size": n} for p, n in grown_frames(v, frame_size, level, checksum)]
            for v in col.to_pylist()
        ]
        return pa.array(rows, pa.list_(pa.struct([("payload", pa.binary()), ("d_size", pa.int64())])))

    made = files.select(key, F.arrow_udf(run, kind)(data).alias("frames"))
    return made.select(key, F.posexplode("frames").alias("frame_id", "f")).select(
        key, F.col("frame_id").cast("bigint"), "f.d_size", "f.payload"
    )


def assemble(frames: DataFrame, key: str, head: bool = False) -> DataFrame:
    """``(key, data, table)``: a file's frames in order, with the table behind them or, with ``head``,
    apart from them."""
    sized = frames.withColumn("c_size", F.octet_length("payload").cast("bigint"))
    table = serialize(sized, (key,), head)
    got = sized.groupBy(key).agg(joined_bytes("payload", "frame_id").alias("data"))
    joined = got.join(table, key)
    return joined if head else joined.select(key, F.concat("data", "table").alias("data"), "table")


def table_of(files: DataFrame, key: str, data: str = "data", head: str | None = None) -> DataFrame:
    """The seek table of each file, from its tail or from a column of its own; broken tables raise."""
    parsed = parse(files, head or data, head is not None)
    sound = F.when(F.col("failure").isNull(), F.col("frames")).otherwise(
        F.raise_error(F.concat(F.lit("bad seek table: "), "failure"))
    )
    each = parsed.select(key, F.explode(sound).alias("f")).select(key, "f.frame_id", "f.c_size", "f.d_size")
    return seek_table(each, (key,))


def payloads(files: DataFrame, frames: DataFrame, key: str, data: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The stored bytes of some frames. A file meets the list of its frames once and is cut there, so it
    is not repeated for each of them."""
    listed = frames.groupBy(key).agg(F.collect_list(F.struct("frame_id", "c_start", "c_size", *keep)).alias("__fs"))
    joined = files.select(key, F.col(data).alias("__data")).join(listed, key)
    cut = F.transform(
        "__fs",
        lambda f: F.struct(
            f["frame_id"].alias("frame_id"),
            *[f[c].alias(c) for c in keep],
            F.substring("__data", (f["c_start"] + 1).cast("int"), f["c_size"].cast("int")).alias("payload"),
        ),
    )
    return joined.select(key, F.explode(cut).alias("f")).select(key, "f.frame_id", *[f"f.{c}" for c in keep], "f.payload")


def read_range(files: DataFrame, key: str, offset: int, length: int, data: str = "data", head: str | None = None) -> DataFrame:
    """``(key, content)``: a range of each file's content. The range meets the seek table first, so
    only frames that it touches are decoded; one that ends past the content raises."""
    table = table_of(files, key, data, head)
    cut = payloads(files, frame_range(table, offset, length), key, data, ("skip", "take"))
    plain = cut.select(key, "frame_id", "skip", "take", decompress(F.col("payload")).alias("plain"))
    part = F.substring("plain", (F.col("skip") + 1).cast("int"), F.col("take").cast("int"))
    got = plain.select(key, "frame_id", part.alias("part")).groupBy(key).agg(joined_bytes("part", "frame_id").alias("content"))
    past = F.raise_error(F.lit("range past the end"))
    whole = F.when(F.octet_length("content") == length, F.col("content")).otherwise(past)
    return got.select(key, whole.alias("content"))


def read_all(files: DataFrame, key: str, data: str = "data", head: str | None = None) -> DataFrame:
    """``(key, content)``: all frames of each file, decoded apart and joined in order."""
    return read_frames(files, key, 0, None, data, head)


def read_frames(files: DataFrame, key: str, first: int, last: int | None, data: str = "data", head: str | None = None) -> DataFrame:
    """``(key, content)`` of frames ``first`` to ``last``, both included."""
    table = table_of(files, key, data, head).where(F.col("frame_id") >= first)
    table = table if last is None else table.where(F.col("frame_id") <= last)
    plain = payloads(files, table, key, data).select(key, "frame_id", decompress(F.col("payload")).alias("part"))
    return plain.groupBy(key).agg(joined_bytes("part", "frame_id").alias("content"))
