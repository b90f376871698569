"""Frames from a stream of chunks, with state for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from zstandard import ZstdError

from cairn.functions.codec import MOST_BYTES, StreamDecoder, zstd_stream_codec
from cairn.plans.seekable import CHUNK, MOST_FRAME

FRAMES = "key string, frame_id bigint, d_size bigint, payload binary"


def frame_stream(chunks: DataFrame, frame_size: int, level: int = 3, checksum: bool = True) -> DataFrame:
    """Frames of ``chunks(key, seq, data, last)``: ``frame_size`` bytes of content each, whatever the
    chunks' bounds.

    State is what no frame has yet and the next number, so it never exceeds a frame and a chunk.
    Chunks of a key must come in order over the batches; within one they are sorted. A chunk with
    ``last`` ends its file: the rest is emitted (an empty frame for an empty file) and the state goes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, pending = (state.get if state.exists else (0, b""))
        rows = pd.concat(list(frames)).sort_values("seq")
        pending = bytes(pending) + b"".join(bytes(x) for x in rows["data"] if x is not None)
        ended = bool(rows["last"].any())
        codec, out = zstd_stream_codec(level, checksum), []
        at = 0
        while len(pending) - at >= frame_size or ended and (at < len(pending) or number == 0):
            part = pending[at : at + frame_size]
            out.append((key[0], number, len(part), codec(part)))
            number, at = number + 1, at + frame_size
        if ended:
            state.remove()
        else:
            state.update((number, pending[at:]))
        yield pd.DataFrame(out, columns=["key", "frame_id", "d_size", "payload"])

    picked = chunks.select(F.col("key").cast("string"), F.col("seq").cast("bigint"), "data", F.coalesce("last", F.lit(False)).alias("last"))
    kind = T.StructType().add("number", T.LongType()).add("pending", T.BinaryType())
    return picked.groupBy("key").applyInPandasWithState(step, FRAMES, kind, "append", GroupStateTimeout.NoTimeout)


PLAIN = "key string, offset bigint, content binary, failure string"


def decode_stream(chunks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The content of ``chunks(key, seq, data, last)`` of zstd files, whatever the chunks' bounds:
    ``(key, offset, content, failure)``.

    Output comes with the chunk that ends its block. State is the unfinished frame, still compressed,
    and how much of its output was given. A stream that breaks, ends within a frame or exceeds
    ``most`` gives one row with a failure, and nothing after it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, given, total, failure = state.get if state.exists else (b"", 0, 0, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        data = b"".join(bytes(x) for x in rows["data"] if x is not None)
        ended, out = bool(rows["last"].any()), []
        if failure is None:
            d = StreamDecoder((pending, given, total), most)
            try:
                plain = d.feed(data)
                if plain:
                    out.append((key[0], total, plain, None))
                if ended:
                    d.close()
            except ZstdError as e:
                failure = str(e)
                out.append((key[0], d.total, None, failure))
            pending, given, total = d.state
        if ended:
            state.remove()
        else:
            state.update((pending if failure is None else b"", given, total, failure))
        yield pd.DataFrame(out, columns=["key", "offset", "content", "failure"])

    last = F.coalesce("last", F.lit(False)).alias("last")
    picked = chunks.select(F.col("key").cast("string"), F.col("seq").cast("bigint"), "data", last)
    kind = T.StructType().add("pending", T.BinaryType()).add("given", T.LongType()).add("total", T.LongType())
    kind = kind.add("failure", T.StringType())
    return picked.groupBy("key").applyInPandasWithState(step, PLAIN, kind, "append", GroupStateTimeout.NoTimeout)


def measured_stream(chunks: DataFrame, frame_size: int, level: int = 3, checksum: bool = True) -> DataFrame:
    """Frames of ``chunks(key, seq, data, last)`` that end once their compressed size reaches
    ``frame_size``. What is taken in at once ends where the stream's own 128 KiB do, so frames do not
    depend on the chunks' bounds. State is the frame begun, what is not yet taken in, and their places.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, consumed, begun, waiting = state.get if state.exists else (0, 0, b"", b"")
        rows = pd.concat(list(frames)).sort_values("seq")
        begun, waiting = bytes(begun), bytes(waiting) + b"".join(bytes(x) for x in rows["data"] if x is not None)
        ended, out, codec = bool(rows["last"].any()), [], zstd_stream_codec(level, checksum)

        def emit(packed: bytes, content: bytes) -> None:
            out.append((key[0], number + len(out), len(content), packed))

        while waiting:
            take = min(CHUNK - consumed % CHUNK, MOST_FRAME - len(begun))
            if len(waiting) < take and not ended:
                break
            begun, waiting, consumed = begun + waiting[:take], waiting[take:], consumed + min(take, len(waiting))
            packed = codec(begun)
            if len(packed) >= frame_size or len(begun) >= MOST_FRAME:
                emit(packed, begun)
                begun = b""
        if ended and (begun or number + len(out) == 0):
            emit(codec(begun), begun)
        if ended:
            state.remove()
        else:
            state.update((number + len(out), consumed, begun, waiting))
        yield pd.DataFrame(out, columns=["key", "frame_id", "d_size", "payload"])

    last = F.coalesce("last", F.lit(False)).alias("last")
    picked = chunks.select(F.col("key").cast("string"), F.col("seq").cast("bigint"), "data", last)
    kind = T.StructType().add("number", T.LongType()).add("consumed", T.LongType())
    kind = kind.add("begun", T.BinaryType()).add("waiting", T.BinaryType())
    return picked.groupBy("key").applyInPandasWithState(step, FRAMES, kind, "append", GroupStateTimeout.NoTimeout)


def arriving_files(spark, directory: str, suffix: str) -> DataFrame:
    """Files as they arrive in a directory: ``(path, modificationTime, length, content)``."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", f"*{suffix}").load(directory)


def progress(events: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Items, bytes and failures by window of event time; late events beyond ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("status") == "Failed").alias("failed"),
            F.sum("bytes").alias("bytes"),
        )
        .select(F.col("window.start").alias("start"), "n", "failed", "bytes")
    )
