"""The block archive format: a Spark data source and sink, ``block_archive``.

Reading lists the entries of archives, with or without their content. Each file of a path is one
partition of entries or, when content is asked for, several: runs of entries of about equal bytes,
each of which reads only the blocks it needs, and each block once. Writing gathers one archive from
blocks that other tasks have compressed, or from files. Places are paths or URIs that Arrow's file
systems reach; of an archive only the footer, the tables and the blocks asked for are read.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cairn.functions.codec import REGISTRY, decode_exact
from cairn.functions.latin import decode_1252, encode_1252

# Fixed values of the format. Integers are big-endian.
BLOCK, SLOTS, RECORD, NODE, FOOTER = 65536, 16, 40, 16, 144
MAGIC, VERSION, ROOT_NAME = 0x169F52D6, 0x61BF3A01, 0x7FFFFFFF
FILE_FLAG, MAX_NAME, MAX_DEPTH = 0x80000000, 0x7FFF, 1024
MAX_NAMES = 0x7FFFFFFF
SECTIONS = ("data", "records", "names", "tree", "meta_directory", "meta_data")


class OpenFailure(ValueError):
    """Why an archive does not open; ``code`` is one word."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Entry:
    path: str
    is_file: bool
    offset: int
    size: int
    safe: bool


def at(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(place)
    scheme, rest = place.split(":", 1)
    found, path = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return found, path


class Archive:
    """An opened archive over a seekable binary file, or the bytes of one.

    ``cache_blocks`` decoded blocks are kept, the last used ones, so that small files of one block
    and reads in small steps decode it once.
    """

    def __init__(self, file: io.BufferedIOBase | bytes, extended_names: bool = True, cache_blocks: int = 16):
        if isinstance(file, bytes | bytearray | memoryview):
            file = io.BytesIO(file)
        if file is None or not file.readable() or not file.seekable():
            raise OpenFailure("InvalidStream")
        self.file, self.cache_blocks = file, cache_blocks
        self.cache: OrderedDict[int, bytes] = OrderedDict()
        file.seek(0, os.SEEK_END)
        size = file.tell()
        if size <= FOOTER:
            raise OpenFailure("TooSmall")
        foot = self._read(size - FOOTER, FOOTER)
        pairs = struct.unpack_from(">12Q", foot)
        self.hash = foot[96:128]
        total, version, magic = struct.unpack_from(">QII", foot, 128)
        self.sections = dict(zip(SECTIONS, zip(pairs[::2], pairs[1::2])))
        if magic != MAGIC:
            raise OpenFailure("BadMagic")
        if version != VERSION:
            raise OpenFailure("UnsupportedVersion")
        if total != size:
            raise OpenFailure("LengthMismatch")
        if any(o > size or n > size - o for o, n in self.sections.values()):
            raise OpenFailure("SectionOutOfRange")
        self.base, self.data_size = self.sections["data"]
        at, n = self.sections["records"]
        if not n or n % RECORD:
            raise OpenFailure("BadOffsetRecords")
        raw = self._read(at, n)
        self.records = [struct.unpack_from(">Q16H", raw, i) for i in range(0, n, RECORD)]
        if self.sections["names"][1] > MAX_NAMES:
            raise OpenFailure("BadNameTable")
        self.names = self._read(*self.sections["names"])
        at, n = self.sections["tree"]
        if not n or n % NODE:
            raise OpenFailure("BadFileTree")
        self.nodes = list(struct.iter_unpack(">4I", self._read(at, n)))
        self.extended = extended_names
        if self.nodes[0][0] & FILE_FLAG or self.name(0):
            raise OpenFailure("BadFileTree")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise OpenFailure("ReadError")
        return data

    def raw_name(self, node: int) -> bytes | None:
        """Bytes of a name, null out of range. Names of 128 bytes or more have two length bytes; read
        as old readers do (``extended_names`` off), their length is wrong."""
        at = self.nodes[node][0] & ~FILE_FLAG
        if at == ROOT_NAME or at >= len(self.names):
            return None
        first = self.names[at]
        n, at = first & 0x7F, at + 1
        if first & 0x80:
            if at >= len(self.names):
                return None
            n |= (self.names[at] if self.extended else first) << 7
            at += 1
        return self.names[at : at + n] if at + n <= len(self.names) else None

    def name(self, node: int) -> str:
        return decode_1252(self.raw_name(node) or b"")

    def entries(self) -> list[Entry]:
        """Depth first, a directory before what it holds; a broken range or too deep a tree raises."""
        out: list[Entry] = []
        stack = [(0, "", 0, True)]
        while stack:
            node, path, depth, safe = stack.pop()
            flag, a, b, c = self.nodes[node]
            if flag & FILE_FLAG:
                out.append(Entry(path, True, a | (c & 0xFFFF) << 32, b | (c >> 16) << 32, safe))
                continue
            if node:
                out.append(Entry(path, False, 0, 0, safe))
            if depth > MAX_DEPTH:
                raise ValueError(f"tree is deeper than {MAX_DEPTH}")
            if b and a + b > len(self.nodes) or b and a <= node:
                raise ValueError("children out of range")
            for child in range(a + b - 1, a - 1, -1):
                name = self.name(child)
                stack.append((child, f"{path}/{name}" if path else name, depth + 1, safe and is_safe(name)))
        return out

    def block(self, i: int) -> bytes | None:
        """A decoded block, null if it is out of range or broken."""
        if i in self.cache:
            self.cache.move_to_end(i)
            return self.cache[i]
        if i >= len(self.records) * SLOTS:
            return None
        base, *sizes = self.records[i // SLOTS]
        at = base + sum(sizes[: i % SLOTS]) + i % SLOTS
        n = sizes[i % SLOTS] + 1
        if at + n > self.data_size:
            return None
        try:
            data = self._read(self.base + at, n)
            data = data if n == BLOCK else decode_exact(data, BLOCK)
        except Exception:
            return None
        if self.cache_blocks:
            self.cache[i] = data
            if len(self.cache) > self.cache_blocks:
                self.cache.popitem(last=False)
        return data

    def open(self, entry: Entry) -> EntryStream:
        """A file of the archive as a seekable stream."""
        return EntryStream(self, entry)

    def read(self, offset: int, size: int, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a file from ``start``, clamped to its size; a broken block makes the read short."""
        stop = size if length is None else min(size, start + length)
        out, at = [], offset + min(start, size)
        end = offset + stop
        while at < end:
            data = self.block(at // BLOCK)
            if data is None:
                break
            part = data[at % BLOCK : at % BLOCK + end - at]
            out.append(part)
            at += len(part)
        return b"".join(out)

    def verify(self) -> bool:
        """Whether the footer's digest is that of the file (readers of the format need not look)."""
        self.file.seek(0, os.SEEK_END)
        size = self.file.tell()
        h = hashlib.sha256()
        self.file.seek(0)
        left = size - FOOTER
        while left:
            part = self.file.read(min(left, 1 << 20))
            h.update(part)
            left -= len(part)
        foot = bytearray(self._read(size - FOOTER, FOOTER))
        foot[96:128] = bytes(32)
        h.update(foot)
        return h.digest() == self.hash


class EntryStream(io.RawIOBase):
    """Reads a file of an archive from any place on; only the blocks that a read touches are decoded."""

    def __init__(self, archive: Archive, entry: Entry):
        self.archive, self.entry, self.place = archive, entry, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        place = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.place, os.SEEK_END: self.entry.size}[whence]
        if place < 0:
            raise ValueError("negative place")
        self.place = place
        return place

    def readinto(self, buffer) -> int:
        data = self.archive.read(self.entry.offset, self.entry.size, self.place, len(buffer))
        if not data and len(buffer) and self.place < self.entry.size:
            raise OSError("broken block")
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)


def is_safe(name: str) -> bool:
    """Whether a name is one plain component that may become a file's name."""
    stem = name.split(".")[0].upper()
    device = stem in ("CON", "PRN", "AUX", "NUL") or (
        len(stem) == 4 and stem[:3] in ("COM", "LPT") and "1" <= stem[3] <= "9"
    )
    drive = len(name) >= 2 and name[1] == ":" and name[0].isascii() and name[0].isalpha()
    return bool(name) and name not in (".", "..") and "/" not in name and "\\" not in name and not device and not drive


def folded(name: bytes) -> bytes:
    return name.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


class ArchiveBuilder:
    """Writes one archive to a binary file, files in the order they are added."""

    def __init__(self, out: io.BufferedIOBase, codec: str = "zstd", names: Iterable[str] = (), parallelism: int = 1, **options):
        """``names`` come first in the name table, in this order; ``parallelism`` threads compress."""
        self.out, self.sha, self.at = out, hashlib.sha256(), 0
        self.codecs = [REGISTRY[codec](**options) for _ in range(parallelism)]
        self.threads = ThreadPoolExecutor(parallelism) if parallelism > 1 else None
        self.queue: deque = deque()
        self.blocks = 0
        self.pending = bytearray()
        self.stream = 0
        self.stored: list[tuple[int, int]] = []
        self.root: dict = {"kids": {}, "name": b""}
        self.name_order: dict[bytes, int] = {}
        for name in names:
            self.name_order.setdefault(encode_1252(name[:MAX_NAME]), len(self.name_order))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.at += len(data)

    def _node(self, path: str, is_file: bool, parents: bool = True) -> dict:
        parts = [p for p in path.replace("\\", "/").split("/") if p]
        if not parts and is_file:
            raise ValueError("a file needs a name")
        node = self.root
        for k, part in enumerate(parts):
            raw = encode_1252(part[:MAX_NAME])
            last = k + 1 == len(parts)
            kid = node["kids"].get(folded(raw))
            if kid is None and not last and not parents:
                raise ValueError(f"no such directory: {'/'.join(parts[: k + 1])}")
            if kid is None:
                self.name_order.setdefault(raw, len(self.name_order))
                kid = {"name": raw, "kids": None if last and is_file else {}}
                node["kids"][folded(raw)] = kid
            elif last and is_file or kid["kids"] is None:
                raise ValueError(f"duplicate entry: {path}")
            node = kid
        return node

    def add_directory(self, path: str, parents: bool = True) -> None:
        """Makes a directory, with those above it unless ``parents`` is off; one that is there stays."""
        self._node(path, False, parents)

    def add_file(self, path: str, content: bytes = b"") -> None:
        """Begins a file; ``append`` adds to the one begun last."""
        self.last = self.add_entry(path, 0)
        self.append(content)

    def append(self, content: bytes) -> None:
        self.last["size"] += len(content)
        self.stream += len(content)
        self.pending += content
        while len(self.pending) >= BLOCK:
            self._block(bytes(self.pending[:BLOCK]))
            del self.pending[:BLOCK]

    def add_entry(self, path: str, size: int) -> dict:
        """A file whose content is in the blocks already, ``size`` bytes after the last one's."""
        node = self._node(path, True)
        node["offset"], node["size"] = self.stream, size
        self.stream += size
        return node

    def add_block(self, payload: bytes) -> None:
        """A block that is compressed already, or raw."""
        self.stored.append((self.at, len(payload)))
        self._put(payload)

    def _compress(self, data: bytes, k: int) -> bytes:
        packed = self.codecs[k](data)
        return data if packed is None or len(packed) >= BLOCK else packed

    def _block(self, data: bytes) -> None:
        if self.threads is None:
            self.add_block(self._compress(data, 0))
            return
        # a codec serves one block at a time: the one it had before has left the queue by then
        if len(self.queue) == len(self.codecs):
            self.add_block(self.queue.popleft().result())
        self.queue.append(self.threads.submit(self._compress, data, self.blocks % len(self.codecs)))
        self.blocks += 1

    def finish(self) -> None:
        if self.pending:
            self._block(bytes(self.pending).ljust(BLOCK, b"\0"))
        while self.queue:
            self.add_block(self.queue.popleft().result())
        if self.threads is not None:
            self.threads.shutdown()
        sections = [(0, self.at)]
        self._put(bytes(-self.at % 8))
        begin = self.at
        for i in range(0, len(self.stored), SLOTS):
            part = self.stored[i : i + SLOTS]
            sizes = [n - 1 for _, n in part] + [0] * (SLOTS - len(part))
            self._put(struct.pack(">Q16H", part[0][0], *sizes))
        sections.append((begin, self.at - begin))
        begin, places = self.at, {}
        for raw in self.name_order:
            places[raw] = self.at - begin
            n = len(raw)
            self._put((bytes([n & 0x7F | 0x80, n >> 7]) if n >= 0x80 else bytes([n])) + raw)
        sections.append((begin, self.at - begin))
        begin, queue, used = self.at, deque([self.root]), 1
        while queue:
            node = queue.popleft()
            place = ROOT_NAME if node is self.root else places[node["name"]]
            if node["kids"] is None:
                o, n = node["offset"], node["size"]
                high = o >> 32 & 0xFFFF | n >> 32 << 16 & 0xFFFF0000
                self._put(struct.pack(">4I", place | FILE_FLAG, o & 0xFFFFFFFF, n & 0xFFFFFFFF, high))
            else:
                kids = [node["kids"][k] for k in sorted(node["kids"])]
                self._put(struct.pack(">4I", place, used, len(kids), 0))
                used += len(kids)
                queue.extend(kids)
        sections.append((begin, self.at - begin))
        sections += [(self.at, 0)] * 2
        total = self.at + FOOTER
        foot = b"".join(struct.pack(">QQ", *s) for s in sections)
        tail = struct.pack(">QII", total, VERSION, MAGIC)
        self.sha.update(foot + bytes(32) + tail)
        self.out.write(foot + self.sha.digest() + tail)


def open_failure(place: str | bytes | io.IOBase, extended_names: bool = True, cache_blocks: int = 16) -> tuple[Archive | None, str]:
    """An archive and no failure, or none and why: of a path or URI, of bytes, or of a stream."""
    try:
        if isinstance(place, str):
            if not place or "\0" in place:
                return None, "InvalidPath"
            system, path = at(place)
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None, "FileNotFound"
            place = system.open_input_file(path)
        return Archive(place, extended_names, cache_blocks), "None"
    except OpenFailure as e:
        return None, e.code
    except FileNotFoundError:
        return None, "FileNotFound"
    except PermissionError:
        return None, "AccessDenied"
    except (IsADirectoryError, ValueError):
        return None, "InvalidPath"
    except OSError:
        return None, "ReadError"


def listed(place: str, suffix: str) -> list[str]:
    """Files of a folder, of its folders too, in order; a file is itself."""
    system, path = at(place)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return [place]
    local = isinstance(system, fs.LocalFileSystem)
    head = "" if local else place.split("://")[0] + "://"
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(head + f.path for f in found if f.is_file and f.path.endswith(suffix))


@dataclass
class Part(InputPartition):
    path: str
    entries: list[Entry] | None


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path = options.get("path")
        if not self.path:
            raise ValueError("option path is missing")
        self.suffix = options.get("suffix", ".zar")
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.extended = options.get("decodeExtendedNames", "true").lower() != "false"
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.cache = int(options.get("cacheBlocks", 16))
        self.prefix = options.get("prefix", "")

    def wanted(self, archive: Archive) -> list[Entry]:
        return [e for e in archive.entries() if e.path.startswith(self.prefix)]

    def partitions(self) -> list[Part]:
        """Archives are only opened here if their content is to be spread over tasks."""
        if "content" not in self.names:
            return [Part(path, None) for path in listed(self.path, self.suffix)]
        parts = []
        for path in listed(self.path, self.suffix):
            archive, _ = open_failure(path, self.extended, 0)
            if archive is None:
                parts.append(Part(path, None))
                continue
            run, size = [], 0
            for e in self.wanted(archive):
                run.append(e)
                size += e.size
                if size >= self.bytes:
                    parts.append(Part(path, run))
                    run, size = [], 0
            parts += [Part(path, run)] * bool(run)
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        archive, failure = open_failure(part.path, self.extended, self.cache)
        if archive is None:
            if self.mode == "FAILFAST":
                raise OpenFailure(failure)
            yield batch_of(self.names, part.path, [None], [None], failure)
            return
        entries = self.wanted(archive) if part.entries is None else part.entries
        run, contents, size = [], [], 0
        for e in entries:
            content = None
            if "content" in self.names and e.is_file:
                content = archive.read(e.offset, e.size)
                if len(content) != e.size and self.mode == "FAILFAST":
                    raise OpenFailure("ReadError")
            run.append(e)
            contents.append(content)
            size += len(content or b"")
            if size >= BATCH or len(run) >= 10_000:
                yield batch_of(self.names, part.path, run, contents)
                run, contents, size = [], [], 0
        if run:
            yield batch_of(self.names, part.path, run, contents)


#: Bytes of content that leave a reader at once.
BATCH = 4 << 20


def batch_of(names: list[str], archive: str, entries: list, contents: list, failure: str | None = None) -> pa.RecordBatch:
    """Entries as the columns that are wanted; one that is None stands for an archive that failed."""
    columns = {
        "archive": (pa.string(), lambda: [archive] * len(entries)),
        "path": (pa.string(), lambda: [e and e.path for e in entries]),
        "is_file": (pa.bool_(), lambda: [e and e.is_file for e in entries]),
        "offset": (pa.int64(), lambda: [e.offset if e and e.is_file else None for e in entries]),
        "size": (pa.int64(), lambda: [e and e.size for e in entries]),
        "safe": (pa.bool_(), lambda: [e and e.safe for e in entries]),
        "content": (pa.binary(), lambda: contents),
        "failure": (pa.string(), lambda: [failure] * len(entries)),
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[n][1](), columns[n][0]) for n in names], names)


@dataclass
class Written(WriterCommitMessage):
    rows: list


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows ``(path, content)``, null content being a directory, or rows ``(path, size, content)``:
    of those without a path, content is a stored block, and the ones with a path come after all blocks
    and name the files, in order, whose ``size`` bytes each the blocks hold (null size: a directory).

    One task writes the archive, so sort the rows and bring them to one partition. Content passes
    through; what stays in memory is the tree of names and a place for each block.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.stored = "size" in schema.names
        self.path, self.codec = options["path"], options.get("codec", "zstd")
        self.level, self.overwrite = int(options.get("level", 6)), overwrite
        self.parallelism = int(options.get("parallelism", 1))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = at(self.path)
        temp, out, builder = f"{path}.{uuid.uuid4().hex}.part", None, None
        options = {"level": self.level} if self.codec == "zstd" else {}
        try:
            for batch in batches:
                if builder is None:
                    out = system.open_output_stream(temp, compression=None)
                    builder = ArchiveBuilder(out, self.codec, parallelism=self.parallelism, **options)
                for name, size, content in self._rows(batch):
                    if self.stored and name is None:
                        builder.add_block(content)
                    elif self.stored and size is not None:
                        builder.add_entry(name, size)
                    elif self.stored or content is None:
                        builder.add_directory(name)
                    else:
                        builder.add_file(name, content)
            if builder is None:
                return Written([])
            builder.finish()
            out.close()
            return Written([temp])
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(temp)
            raise

    def _rows(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        names, contents = batch.column("path").to_pylist(), batch.column("content")
        sizes = batch.column("size").to_pylist() if self.stored else [None] * batch.num_rows
        for k, (name, size) in enumerate(zip(names, sizes)):
            yield name, size, contents[k].as_py()

    def commit(self, messages: list) -> None:
        system, path = at(self.path)
        temps = [t for m in messages if m for t in m.rows]
        if len(temps) > 1:
            self.abort(messages)
            raise ValueError("an archive is written by one task: use coalesce(1)")
        if not self.overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        if temps:
            system.move(temps[0], path)
        else:
            with system.open_output_stream(path, compression=None) as out:
                ArchiveBuilder(out).finish()

    def abort(self, messages: list) -> None:
        system, _ = at(self.path)
        for t in (t for m in messages if m for t in m.rows):
            if system.get_file_info(t).type != fs.FileType.NotFound:
                system.delete_file(t)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_archive"

    def schema(self) -> str:
        content = ", content binary" if self.options.get("content", "true").lower() != "false" else ""
        return f"archive string, path string, is_file boolean, offset bigint, size bigint, safe boolean{content}, failure string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(schema, self.options, overwrite)
