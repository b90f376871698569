"""Compression of BINARY columns: Arrow UDFs over the zstd library, one codec per worker.

Results depend on the library's version where compressed bytes are concerned, never for content.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how a frame of any size is refused beyond so many bytes unless a caller allows more.
MOST_BYTES = 1 << 31

Codec = Callable[[bytes], bytes | None]
REGISTRY: dict[str, Callable[..., Codec]] = {}


def register(name: str) -> Callable:
    """Add a codec factory by name; its codec belongs to one worker and is never called twice at once."""

    def add(factory: Callable[..., Codec]) -> Callable[..., Codec]:
        REGISTRY[name] = factory
        return factory

    return add


def dictionary(data: bytes | None, raw: bool = False) -> zstd.ZstdCompressionDict | None:
    """A dictionary from its bytes: formatted if it begins as one does, else (or if ``raw``) a plain prefix."""
    if not data:
        return None
    kind = zstd.DICT_TYPE_RAWCONTENT if raw else zstd.DICT_TYPE_AUTO
    return zstd.ZstdCompressionDict(data, dict_type=kind)


@register("raw")
def raw_codec() -> Codec:
    """Declines every block, which is then stored as it is."""
    return lambda data: None


@register("zstd")
def zstd_codec(level: int = 6, checksum: bool = False, dict_data: bytes | None = None, raw_dict: bool = False) -> Codec:
    """One frame with its content size, at levels 1 to 22."""
    if not 1 <= level <= 22:
        raise ValueError("level must be from 1 to 22")
    made: list = []

    def run(data: bytes) -> bytes:
        if not made:
            made.append(
                zstd.ZstdCompressor(level, dict_data=dictionary(dict_data, raw_dict), write_checksum=checksum)
            )
        return made[0].compress(data)

    return run


@register("zstd-stream")
def zstd_stream_codec(level: int = 3, checksum: bool = True, dict_data: bytes | None = None) -> Codec:
    """A frame as a stream writes it: its content size is unknown when it begins (but for no content)."""

    def run(data: bytes) -> bytes:
        c = zstd.ZstdCompressor(level, dict_data=dictionary(dict_data), write_checksum=checksum)
        if not data:
            return c.compress(b"")
        o = c.compressobj()
        return o.compress(data) + o.flush()

    return run


@lru_cache(16)
def _decoder(dict_data: bytes | None, window: int) -> zstd.ZstdDecompressor:
    """One for each worker and dictionary."""
    return zstd.ZstdDecompressor(dict_data=dictionary(dict_data), max_window_size=window)


#: Fixed values of the frame format.
FRAME_MAGIC, SKIPPABLE_LOW, SKIPPABLE_HIGH = 0xFD2FB528, 0x184D2A50, 0x184D2A5F
#: Bytes of output asked of a frame at a time.
STEP = 1 << 20


def frame_end(data: bytes, at: int = 0) -> int | None:
    """Where the frame or skippable frame that begins at ``at`` ends, from its headers alone; None if the
    data end before it does, so more must come. What is no frame raises."""
    if at + 4 > len(data):
        return None
    magic = int.from_bytes(data[at : at + 4], "little")
    if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little") if at + 8 <= len(data) else len(data) + 1
        return end if end <= len(data) else None
    if magic != FRAME_MAGIC:
        raise zstd.ZstdError("not a frame")
    if at + 5 > len(data):
        return None
    flags = data[at + 4]
    single = flags >> 5 & 1
    place = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if place + 3 > len(data):
            return None
        head = int.from_bytes(data[place : place + 3], "little")
        kind = head >> 1 & 3
        if kind == 3:
            raise zstd.ZstdError("reserved block type")
        place += 3 + (1 if kind == 1 else head >> 3)
        if head & 1:
            break
    place += 4 if flags & 4 else 0
    return place if place <= len(data) else None


def decode_frame(data: bytes, most: int, dict_data: bytes | None = None, window: int = MOST_BYTES) -> bytes:
    """One whole frame. Its output never grows beyond ``most``: a frame that says its size is refused
    by that, any other as soon as it has given more."""
    said = zstd.frame_content_size(data)
    if said > most:
        raise zstd.ZstdError(f"content exceeds {most} bytes")
    if zstd.get_frame_parameters(data).window_size > window and said != 0:
        raise zstd.ZstdError(f"window exceeds {window} bytes")
    d = _decoder(dict_data, MOST_BYTES)
    if said >= 0:
        return d.decompress(data, max_output_size=said)
    out, size = [], 0
    with d.stream_reader(data, read_across_frames=False) as reader:
        while part := reader.read(min(STEP, most - size + 1)):
            size += len(part)
            if size > most:
                raise zstd.ZstdError(f"content exceeds {most} bytes")
            out.append(part)
    return b"".join(out)


def decode_frames(data: bytes, most: int = MOST_BYTES, dict_data: bytes | None = None, window: int = MOST_BYTES) -> bytes:
    """All frames one after the other; skippable ones are skipped. Anything else raises. ``most`` bounds
    the output of all together while it is made, ``window`` what a frame may ask for."""
    out, size, at = [], 0, 0
    while at < len(data):
        end = frame_end(data, at)
        if end is None:
            raise zstd.ZstdError("truncated frame")
        if int.from_bytes(data[at : at + 4], "little") == FRAME_MAGIC:
            out.append(decode_frame(data[at:end], most - size, dict_data, window))
            size += len(out[-1])
        at = end
    return out[0] if len(out) == 1 else b"".join(out)


def decode_exact(data: bytes, size: int, dict_data: bytes | None = None) -> bytes:
    """The first frame, which must hold just ``size`` bytes and, if it says so at all, say so."""
    said = zstd.frame_content_size(data)
    if said not in (-1, size):
        raise zstd.ZstdError(f"frame holds {said} bytes, not {size}")
    end = frame_end(data)
    if end is None:
        raise zstd.ZstdError("truncated frame")
    out = decode_frame(data if end == len(data) else data[:end], size, dict_data)
    if len(out) != size:
        raise zstd.ZstdError(f"frame does not hold {size} bytes")
    return out


class StreamDecoder:
    """Decodes a stream that comes in pieces of any size; output comes as soon as its block is whole.

    ``state`` is all it needs to go on elsewhere: the bytes of the unfinished frame and how much of
    its output was given. A piece decodes the unfinished frame anew, so state stays compressed.
    """

    def __init__(self, state: tuple[bytes, int, int] = (b"", 0, 0), most: int = MOST_BYTES, dict_data: bytes | None = None):
        self.pending, self.given, self.total = bytes(state[0]), state[1], state[2]
        self.most, self.dict_data = most, dict_data

    @property
    def state(self) -> tuple[bytes, int, int]:
        return self.pending, self.given, self.total

    def feed(self, data: bytes) -> bytes:
        out, raw, at = [], self.pending + data, 0
        while at < len(raw):
            end = frame_end(raw, at)
            frame = raw[at:end] if end else raw[at:]
            if int.from_bytes(frame[:4].ljust(4, b"\0"), "little") == FRAME_MAGIC and len(frame) > 4:
                plain = self._output(frame)
                out.append(plain[self.given :])
                self.total += len(out[-1])
                self.given = 0 if end else len(plain)
            if end is None:
                break
            at = end
        self.pending = raw[at:]
        return b"".join(out)

    def _output(self, frame: bytes) -> bytes:
        """What the frame so far gives, no more than may still come."""
        room, out, size = self.most - self.total + self.given, [], 0
        o = _decoder(self.dict_data, MOST_BYTES).decompressobj()
        for i in range(0, len(frame), 1 << 10):
            part = o.decompress(frame[i : i + (1 << 10)])
            size += len(part)
            if size > room:
                raise zstd.ZstdError(f"content exceeds {self.most} bytes")
            out.append(part)
        return b"".join(out)

    def close(self) -> None:
        """Ends the stream; a frame that is not whole raises."""
        if self.pending:
            raise zstd.ZstdError("truncated frame")


def _binary(f: Callable[[bytes], bytes | None]) -> Callable[[Column], Column]:
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())


def compress(data: Column, codec: str = "zstd", **options) -> Column:
    """BINARY through a registered codec; null where the codec declines, and for null."""
    return _binary(REGISTRY[codec](**options))(data)


def decompress(data: Column, most: int = MOST_BYTES, dict_data: bytes | None = None, fail: bool = True) -> Column:
    """Content of all frames; broken input raises, or gives null unless ``fail``."""

    def run(v: bytes) -> bytes | None:
        try:
            return decode_frames(v, most, dict_data)
        except zstd.ZstdError:
            if fail:
                raise
            return None

    return _binary(run)(data)


def decompress_exact(data: Column, size: Column, dict_data: bytes | None = None, fail: bool = True) -> Column:
    """Content of one frame of a known size."""

    def run(col: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for v, n in zip(col.to_pylist(), sizes.to_pylist()):
            try:
                out.append(None if v is None or n is None else decode_exact(v, n, dict_data))
            except zstd.ZstdError:
                if fail:
                    raise
                out.append(None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, T.BinaryType())(data, size)


def xxh64(data: Column, seed: int = 0) -> Column:
    """XXH64 as 16 hex digits. With seed 42 Spark's own function gives the same number."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else xxhash.xxh64_hexdigest(v, seed) for v in col.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())(data)


def parameters(level: int, size: int) -> dict[str, int]:
    """Search parameters that the library takes for a level and a content size."""
    p = zstd.ZstdCompressionParameters.from_level(level, source_size=size)
    names = "window_log chain_log hash_log search_log min_match target_length strategy"
    return {n: getattr(p, n) for n in names.split()}
