"""Whole files through the codec: listing, compressing, decompressing and seek tables, one task an item."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import parsing
from cairn.functions.codec import MOST_BYTES, dictionary
from cairn.functions.paths import extension
from cairn.operators import seek
from cairn.plans.archives import POLICIES, each_item, resolve
from cairn.sources.archive import at

#: Bytes read at a time, of plain and of compressed files.
CHUNK, STEP = 1 << 20, 1 << 12


def processable(spark: SparkSession, directory: str, mode: str = "Auto") -> DataFrame:
    """``(path, is_dir, kind)`` of the entries right below a directory that a mode takes, to be read in
    order of path; a directory that cannot be listed has none."""
    try:
        system, place = at(directory)
        found = [(f.path, f.type == fs.FileType.Directory) for f in system.get_file_info(fs.FileSelector(place))]
    except OSError:
        found = []
    rows = spark.createDataFrame(found, "path string, is_dir boolean")
    suffix = extension(F.col("path"))
    taken = rows.where(parsing.accepts(F.lit(mode), suffix, ~F.col("is_dir"), F.col("is_dir")))
    return taken.withColumn("kind", parsing.input_kind(F.col("is_dir"), suffix)).orderBy("path")


def first_image(paths: DataFrame, path: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """The first disc image among paths, by code point, null if there is none."""
    image = F.when(extension(F.col(path)).isin(*parsing.ISO_EXTENSIONS), F.col(path))
    return paths.groupBy(*within).agg(F.min(image).alias("first"))


def _write(place: str, policy: str, run: Callable) -> str | None:
    """Writes beside ``place`` and moves there once ``run`` has ended well; None if it is to be skipped."""
    out = resolve(place, policy)
    if out is None:
        return None
    system, path = at(out)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(temp, compression=None) as stream:
            run(stream)
        system.move(temp, path)
    except BaseException:
        if system.get_file_info(temp).type != fs.FileType.NotFound:
            system.delete_file(temp)
        raise
    return out


def _parts(place: str) -> Iterator[bytes]:
    system, path = at(place)
    with system.open_input_stream(path, compression=None) as stream:
        while part := stream.read(CHUNK):
            yield part


def compress_files(
    items: DataFrame,
    level: int = 3,
    policy: str = "Fail",
    checksum: bool = True,
    frame_size: int | None = None,
    dict_data: bytes | None = None,
    delete_source: bool = False,
    stop: str | None = None,
) -> DataFrame:
    """Each source file as a zstd file; with ``frame_size`` as a seekable one, with frames of so many bytes
    and a seek table. Files pass through in parts, so none has to fit in memory."""

    def one(source: str, destination: str) -> tuple[str | None, int, int]:
        size = 0

        def run(out) -> None:
            nonlocal size
            table, pending = [], b""
            c = zstd.ZstdCompressor(level, dict_data=dictionary(dict_data), write_checksum=checksum)
            if frame_size is None:
                o = c.compressobj()
                for part in _parts(source):
                    size += len(part)
                    out.write(o.compress(part))
                out.write(o.flush())
                return

            def frame(data: bytes) -> None:
                packed = c.compress(data)
                table.append((len(packed), len(data)))
                out.write(packed)

            for part in _parts(source):
                size += len(part)
                pending += part
                while len(pending) >= frame_size:
                    frame(pending[:frame_size])
                    pending = pending[frame_size:]
            if pending or not table:
                frame(pending)
            out.write(seek_table_bytes(table))

        out = _write(destination, policy, run)
        return out, int(out is not None), size

    return each_item(items, one, delete_source, stop)


def seek_table_bytes(frames: list[tuple[int, int]]) -> bytes:
    """The seek table of (stored, content) sizes, as it stands at a file's end."""
    little = lambda x: x.to_bytes(4, "little")
    entries = b"".join(little(c) + little(d) for c, d in frames)
    tail = little(len(frames)) + b"\0" + little(seek.SEEKABLE_MAGIC)
    return little(seek.SKIPPABLE_MAGIC) + little(len(entries) + len(tail)) + entries + tail


def decompress_files(
    items: DataFrame,
    policy: str = "Fail",
    most: int = MOST_BYTES,
    dict_data: bytes | None = None,
    delete_source: bool = False,
    stop: str | None = None,
) -> DataFrame:
    """Each zstd file's content, all frames, skippable ones left out; what is broken leaves no output."""

    def one(source: str, destination: str) -> tuple[str | None, int, int]:
        size = 0

        def run(out) -> None:
            nonlocal size
            d = zstd.ZstdDecompressor(dict_data=dictionary(dict_data), max_window_size=MOST_BYTES)
            system, path = at(source)
            o, begun, left = d.decompressobj(), False, b""
            with system.open_input_stream(path, compression=None) as stream:
                while part := left or stream.read(STEP):
                    plain = o.decompress(part)
                    begun, left = True, b""
                    size += len(plain)
                    if size > most:
                        raise zstd.ZstdError(f"content exceeds {most} bytes")
                    out.write(plain)
                    if o.eof:  # the next frame, or a skippable one, begins anew
                        left, begun = o.unused_data, False
                        o = d.decompressobj()
            if begun:
                raise zstd.ZstdError("truncated frame")

        out = _write(destination, policy, run)
        return out, int(out is not None), size

    return each_item(items, one, delete_source, stop)


def tables(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(path, failure, frames)`` of seekable files: only each one's tail is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, tails = b.column(0).to_pylist(), []
            for name in names:
                tails.append(tail(name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tails, pa.binary())], ["path", "data"])

    found = paths.select(F.col(path).alias("path")).mapInArrow(read, "path string, data binary")
    return seek.parse(found).select("path", "failure", "frames")


def tail(place: str) -> bytes:
    """The end of a file that holds its seek table, if it has one."""
    system, path = at(place)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(max(0, size - seek.INTEGRITY))
        last = f.read(seek.INTEGRITY)
        if len(last) < seek.INTEGRITY or int.from_bytes(last[5:], "little") != seek.SEEKABLE_MAGIC:
            return last
        width = seek.CHECKED_ENTRY if last[4] & 0x80 else seek.ENTRY
        whole = min(size, min(int.from_bytes(last[:4], "little"), seek.MAX_FRAMES) * width + seek.HEADER + seek.INTEGRITY)
        f.seek(size - whole)
        return f.read(whole)


def list_frames(paths: DataFrame, path: str = "path", first: int = 0, last: int | None = None) -> DataFrame:
    """A row for each frame of seekable files, with its place and size on both axes; ``first`` to ``last``,
    both included. A file without a sound table raises."""
    found = tables(paths, path)
    sound = F.when(F.col("failure").isNull(), F.col("frames")).otherwise(
        F.raise_error(F.concat(F.lit("bad seek table: "), "failure"))
    )
    each = found.select("path", F.explode(sound).alias("f")).select("path", "f.frame_id", "f.c_size", "f.d_size")
    table = seek.seek_table(each, ("path",)).where(F.col("frame_id") >= first)
    return table if last is None else table.where(F.col("frame_id") <= last)


def list_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Frames, sizes, largest frames and ratio of each seekable file."""
    found = tables(paths, path).select("path", F.explode("frames").alias("f"))
    return seek.summary(found.select("path", "f.frame_id", "f.c_size", "f.d_size"), ("path",))


@dataclass(frozen=True)
class Settings:
    """What a front end remembers. Members that a file lacks or has of a wrong kind keep their defaults."""

    source_dir: str = ""
    target_dir: str = ""
    workers: int = 4
    policy: str = "Fail"
    mode: str = "Auto"

    @classmethod
    def load(cls, place: str) -> Settings:
        """The settings of a JSON file; a missing or broken one gives the defaults."""
        try:
            system, path = at(place)
            with system.open_input_stream(path, compression=None) as f:
                found = json.loads(f.read().decode())
        except (OSError, ValueError):
            return cls()
        found = found if isinstance(found, dict) else {}
        default = cls()
        sound = {k: v for k, v in found.items() if k in cls.__dataclass_fields__ and type(v) is type(getattr(default, k))}
        if sound.get("policy", "Fail") not in POLICIES:
            del sound["policy"]
        return cls(**sound | ({"workers": max(1, sound["workers"])} if "workers" in sound else {}))

    def save(self, place: str) -> None:
        system, path = at(place)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path, compression=None) as f:
            f.write(json.dumps(self.__dict__, indent=2).encode())


@dataclass(frozen=True)
class Request:
    """A batch as it is asked for; ``options`` is what ``archives.batch`` takes of it."""

    items: list[str] = field(default_factory=list)
    target: str = ""
    mode: str = "Auto"
    keep_originals: bool = True
    policy: str = "Fail"
    workers: int = 4

    def options(self) -> dict:
        return {"policy": self.policy, "delete_source": not self.keep_originals}

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(source, destination)`` of each item, dealt over ``workers`` tasks."""
        named = [(i, os.path.join(self.target, os.path.basename(i.rstrip("/")) + ".zar")) for i in self.items]
        return spark.createDataFrame(named, "source string, destination string").repartition(max(1, self.workers))
