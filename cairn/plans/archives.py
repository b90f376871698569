"""Packing and extracting whole trees."""

from __future__ import annotations

import io
import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.codec import compress
from cairn.functions.paths import components, default_archive_name, stays_inside
from cairn.operators.layout import BLOCK_SIZE, block_overlap, file_layout, offset_records, stored_size
from cairn.sources.archive import (
    Archive,
    ArchiveBuilder,
    ArchiveReader,
    ArchiveSource,
    ArchiveWriter,
    OpenFailure,
    Written,
    at,
    batch_of,
    open_failure,
)

SUFFIX = ".zar"
POLICIES = ("Fail", "Skip", "Overwrite", "AutoRename")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def walk(directory: str) -> list[tuple[str, str | None]]:
    """(path below the directory, file or None for a directory), in order of path; links to
    directories are not followed."""
    out: list[tuple[str, str | None]] = []
    for d, dirs, files in os.walk(directory):
        for name in dirs + files:
            full = os.path.join(d, name)
            rel = os.path.relpath(full, directory).replace(os.sep, "/")
            if name in files:
                out.append((rel, full))
            elif not os.path.islink(full):
                out.append((rel, None))
    return sorted(out)


def source(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, is_dir, length, content)`` of a directory that all executors see; content is read by
    the tasks that need it."""
    listed = spark.createDataFrame(
        [(p, f is None, f) for p, f in walk(directory)], "path string, is_dir boolean, file string"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, is_dir, file in zip(*(b.column(i).to_pylist() for i in range(3))):
                content = None
                if file is not None:
                    with open(file, "rb") as f:
                        content = f.read()
                size = 0 if content is None else len(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([is_dir]), pa.array([size], pa.int64()), pa.array([content], pa.binary())],
                    ["path", "is_dir", "length", "content"],
                )

    return listed.mapInArrow(read, "path string, is_dir boolean, length bigint, content binary")


def blocks(files: DataFrame, path: str, content: str, block_size: int = BLOCK_SIZE, codec: str = "zstd", **options) -> DataFrame:
    """``(block_id, stored, payload)`` of the stream of all files in order of path.

    Files are placed by running sums, cut into slices by block, and each block's slices are put
    together in order and compressed: work is spread by block, whatever the files' sizes.
    """
    placed = file_layout(files, path, F.octet_length(content))
    cut = block_overlap(placed, block_size).select(
        "block_id",
        "in_block",
        F.substring(content, (F.col("in_file") + 1).cast("int"), F.col("length").cast("int")).alias("slice"),
    )
    joined = F.expr("listagg(slice) WITHIN GROUP (ORDER BY in_block)")
    whole = cut.groupBy("block_id").agg(joined.alias("joined"))
    filled = whole.select("block_id", F.rpad("joined", block_size, F.unhex(F.lit("00"))).alias("raw"))
    packed = filled.select("block_id", "raw", compress(F.col("raw"), codec, **options).alias("z"))
    small = F.octet_length("z") < block_size
    return packed.select(
        "block_id",
        stored_size(F.octet_length("z").cast("bigint"), block_size).alias("stored"),
        F.when(small, F.col("z")).otherwise(F.col("raw")).alias("payload"),
    )


def index(blocks_: DataFrame) -> DataFrame:
    """The offset records of blocks."""
    return offset_records(blocks_.select("block_id", "stored"))


def resolve(path: str, policy: str) -> str | None:
    """Where output goes if ``path`` is taken: None to skip it, or another name, or an error."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    if not os.path.lexists(path) or policy == "Overwrite":
        return path
    if policy == "Skip":
        return None
    if policy == "Fail":
        raise FileExistsError(path)
    return free_sibling(path)


def free_sibling(path: str) -> str:
    head, tail = os.path.split(path)
    stem, ext = os.path.splitext(tail)
    n = 1
    while os.path.lexists(found := os.path.join(head, f"{stem}_{n}{ext}")):
        n += 1
    return found


def pack(files: DataFrame, archive: str, policy: str = "Fail", level: int = 6, codec: str = "zstd") -> str | None:
    """Write ``files(path, content)`` as one archive, in order of path; null content is a directory.

    Blocks are compressed by all tasks; one task puts them one after the other and writes the tables.
    Returns where the archive is, None if it was skipped.
    """
    out = resolve(archive, policy)
    if out is None:
        return None
    options = {"level": level} if codec == "zstd" else {}
    stored = blocks(files.where("content IS NOT NULL"), "path", "content", codec=codec, **options)
    named = files.select(F.lit(None).cast("bigint").alias("block_id"), "path", F.octet_length("content").cast("bigint").alias("size"))
    rows = stored.select("block_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("size"), F.col("payload").alias("content"))
    rows = rows.unionByName(named.withColumn("content", F.lit(None).cast("binary"))).repartition(1)
    rows = rows.sortWithinPartitions(F.asc_nulls_last("block_id"), "path").select("path", "size", "content")
    writer = ArchiveWriter(rows.schema, {"path": out, "codec": codec, "level": str(level)}, policy == "Overwrite")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(writer.write(batches).rows, pa.string())], ["part"])

    writer.commit([Written([r.part]) for r in rows.mapInArrow(write, "part string").collect()])
    return out


def entries(spark: SparkSession, path: str, content: bool = False, **options) -> DataFrame:
    """Entries of an archive, or of all of a folder, as the data source ``block_archive`` gives them with
    the same options; tasks of this form share the workers that other tasks use."""
    given = {"path": path, "content": str(content).lower()} | {k: str(v) for k, v in options.items()}
    schema = ArchiveSource(given).schema()
    reader = ArchiveReader(T.StructType.fromDDL(schema), given)
    parts = [(bytearray(pickle.dumps(p)),) for p in reader.partitions()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                yield from reader.read(pickle.loads(part))

    dealt = spark.createDataFrame(parts, "part binary").repartition(max(1, len(parts)))
    return dealt.mapInArrow(run, schema)


def read_ranges(requests: DataFrame, archive: str, path: str = "path", start: str = "start", length: str = "length") -> DataFrame:
    """``requests`` with ``content``: so many bytes of a file of the archive from a place on, clamped to
    the file, null where there is no such file. Requests are dealt out by path; a task opens the archive
    once and decodes each block that its requests share once."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, failure = open_failure(archive, cache_blocks=64)
        if opened is None:
            raise OpenFailure(failure)
        found = {e.path.translate(FOLD): e for e in opened.entries() if e.is_file}
        for b in batches:
            out = []
            for p, s, n in zip(*(b.column(c).to_pylist() for c in (path, start, length))):
                e = found.get("/".join(x for x in (p or "").replace("\\", "/").split("/") if x).translate(FOLD))
                out.append(None if e is None else opened.read(e.offset, e.size, s, n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "content"])

    return requests.repartition(path).mapInArrow(run, kind + ", content binary")


#: Letters that names are told apart without.
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of BINARY archives that go to a Python worker at once, however many a task has.
BATCH_BYTES = 4 << 20


def packed_values(files: DataFrame, key: str, level: int = 6, codec: str = "zstd") -> DataFrame:
    """``(key, data)``: the ``(path, content)`` rows of each key as one archive, a BINARY value, in order
    of path; null content is a directory. One task builds an archive and holds it, so a key should have
    no more than that; archives of any size are ``pack``'s."""
    options = {"level": level} if codec == "zstd" else {}

    def build(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        b = ArchiveBuilder(out, codec, **options)
        for path, content in sorted(zip(rows["path"].to_pylist(), rows["content"].to_pylist()), key=lambda r: r[0]):
            if content is None:
                b.add_directory(path)
            else:
                b.add_file(path, content)
        b.finish()
        return pa.table([rows[key].slice(0, 1), pa.array([out.getvalue()], pa.binary())], [key, "data"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "path", "content").groupBy(key).applyInArrow(build, f"`{key}` {kind}, data binary")


def entries_in(files: DataFrame, key: str = "path", data: str = "content", content: bool = False) -> DataFrame:
    """Entries of archives that are BINARY values, as Spark's own readers give them from any store.
    A value that is no archive gives one row that says why. Spark reads the size of a batch when the
    job begins, after this returns, so it stays set for the session."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = ["archive", "path", "is_file", "offset", "size", "safe", *["content"] * content, "failure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1)):
                opened, failure = open_failure(value.as_py() if value.is_valid else b"")
                found = [None] if opened is None else opened.entries()
                bodies = [opened.read(e.offset, e.size) if e and e.is_file and content else None for e in found]
                yield batch_of(names, name, found, bodies, None if opened else failure)

    body = ", content binary" if content else ""
    schema = f"archive string, path string, is_file boolean, offset bigint, size bigint, safe boolean{body}, failure string"
    return files.select(F.col(key).cast("string"), data).mapInArrow(run, schema)


STATUS = "source string, destination string, status string, error string, files bigint, bytes bigint"


def extract(archive: str, destination: str) -> tuple[int, int]:
    """Files and bytes written below ``destination``. Each file is written beside its place and moved
    there once it is whole; names that could leave the destination raise before anything is written."""
    with open(archive, "rb") as f:
        a = Archive(f)
        found = a.entries()
        for e in found:
            if not e.safe:
                raise ValueError(f"entry name is not safe: {e.path}")
        os.makedirs(destination, exist_ok=True)
        files = total = 0
        for e in found:
            place = os.path.join(destination, *e.path.split("/"))
            if not e.is_file:
                os.makedirs(place, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(place), exist_ok=True)
            temp = f"{place}.{uuid.uuid4().hex}.part"
            try:
                with open(temp, "wb") as out:
                    for at in range(0, e.size, BLOCK_SIZE):
                        part = a.read(e.offset, e.size, at, min(BLOCK_SIZE, e.size - at))
                        if len(part) != min(BLOCK_SIZE, e.size - at):
                            raise OpenFailure("ReadError")
                        out.write(part)
                os.replace(temp, place)
            finally:
                if os.path.exists(temp):
                    os.unlink(temp)
            files, total = files + 1, total + e.size
    return files, total


def pack_one(directory: str, archive: str, level: int, policy: str = "Fail") -> tuple[str | None, int, int]:
    """(where, files, bytes) of a directory packed by the task itself."""
    out = resolve(archive, policy)
    if out is None:
        return None, 0, 0
    temp, files, total = f"{out}.{uuid.uuid4().hex}.part", 0, 0
    try:
        with open(temp, "wb") as f:
            b = ArchiveBuilder(f, level=level)
            for path, file in walk(directory):
                if file is None:
                    b.add_directory(path)
                else:
                    with open(file, "rb") as content:
                        data = content.read()
                    b.add_file(path, data)
                    files, total = files + 1, total + len(data)
            b.finish()
        out = place_file(temp, out, policy)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return out, files, total


def place_file(temp: str, wanted: str, policy: str) -> str | None:
    """Moves a finished file to ``wanted`` without ever replacing what came there meanwhile, unless the
    policy is to overwrite: a link either is made or is not. None if it is to be skipped."""
    while policy != "Overwrite":
        try:
            os.link(temp, wanted)
            os.unlink(temp)
            return wanted
        except FileExistsError:
            taken = resolve(wanted, policy)
            if taken is None:
                return None
            wanted = taken
    os.replace(temp, wanted)
    return wanted


def each_item(
    items: DataFrame, run: Callable[[str, str], tuple[str | None, int, int]], delete_source: bool = False, stop: str | None = None
) -> DataFrame:
    """A result row for each ``(source, destination)``: ``run`` gives where output went (None if it was
    skipped), files and bytes.

    Items run apart from each other, and one that fails says so in its row and stops no other. Items
    that begin after a file ``stop`` is there are cancelled. A source is deleted only once its output
    is in place.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATUS.split(", ")]
        for b in batches:
            for source_, destination in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                status, error, files, size = "Completed", None, 0, 0
                try:
                    if stop is not None and there(stop):
                        status = "Cancelled"
                    else:
                        out, files, size = run(source_, destination)
                        status, destination = ("Completed", out) if out else ("Skipped", destination)
                        if out and delete_source:
                            remove(source_)
                except Exception as e:
                    status, error = "Failed", f"{type(e).__name__}: {e}"
                values = [source_, destination, status, error, files, size]
                types = [pa.string()] * 4 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    return items.select("source", "destination").mapInArrow(rows, STATUS)


def there(place: str) -> bool:
    system, path = at(place)
    return system.get_file_info(path).type != fs.FileType.NotFound


def remove(place: str) -> None:
    """Deletes a file, or a directory with all below it."""
    system, path = at(place)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
    else:
        system.delete_file(path)


def batch(
    items: DataFrame,
    operation: str,
    policy: str = "Fail",
    level: int = 6,
    delete_source: bool = False,
    stop: str | None = None,
) -> DataFrame:
    """``each_item``; ``operation`` is pack (a directory) or extract (an archive)."""
    if operation == "pack":
        return each_item(items, lambda s, d: pack_one(s, d, level, policy), delete_source, stop)
    if operation == "extract":
        return each_item(items, lambda s, d: (d, *extract(s, d)), delete_source, stop)
    raise ValueError("operation must be pack or extract")


def archive_name(directory: Column) -> Column:
    return default_archive_name(directory, SUFFIX)


def escapes(path: Column) -> Column:
    """Paths that extraction refuses."""
    return ~stays_inside(path) | (F.size(components(path)) == 0)
