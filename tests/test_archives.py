"""Round trips, corruption and policies of archives, codecs and seekable files."""

import io
import os
import random

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cairn.functions import codec, latin
from cairn.plans import archives, seekable
from cairn.sources.archive import BLOCK, FOOTER, Archive, ArchiveBuilder, OpenFailure, open_failure


def pattern(n):
    return bytes(i % 251 for i in range(n))


TREE = {
    "a.txt": b"hello world\n",
    "sub/b.bin": b"".join(b"line %d\n" % i for i in range(1, 101)),
    "sub/deep/c.txt": b"",
    "café.txt": b"x",
    "UPPER.TXT": b"y",
    **{f"sizes/{n}": pattern(n) for n in (0, 1, 65535, 65536, 65537, 131085)},
    "random.bin": random.Random(12345).randbytes(300_000),
    "n" * 200: b"long name",
}


def built(tree=TREE, dirs=("empty",), **options):
    out = io.BytesIO()
    b = ArchiveBuilder(out, **options)
    for d in dirs:
        b.add_directory(d)
    for p in sorted(tree):
        b.add_file(p, tree[p])
    b.finish()
    return out.getvalue()


@pytest.mark.parametrize("options", [{}, {"level": 1}, {"codec": "raw"}])
def test_archive_round_trip(options):
    a = Archive(io.BytesIO(built(**options)))
    assert a.verify()
    found = {e.path: a.read(e.offset, e.size) for e in a.entries() if e.is_file}
    assert found == TREE
    assert {e.path for e in a.entries() if not e.is_file} == {"empty", "sub", "sub/deep", "sizes"}
    big = next(e for e in a.entries() if e.path == "random.bin")
    assert a.read(big.offset, big.size, 65_000, 2000) == TREE["random.bin"][65_000:67_000]
    assert a.read(big.offset, big.size, 299_990, 500) == TREE["random.bin"][299_990:]


def test_siblings_are_ordered_by_folded_name():
    a = Archive(io.BytesIO(built({"b": b"1", "A": b"1", "aa": b"1", "É": b"1", "é": b"1"}, ())))
    assert [e.path for e in a.entries()] == ["A", "aa", "b", "É", "é"]


def test_old_readers_misread_long_names():
    a = Archive(io.BytesIO(built({"n" * 200: b"x"}, ())), extended_names=False)
    assert [e.path for e in a.entries()] == [""]


def test_duplicates_and_clashes_raise():
    b = ArchiveBuilder(io.BytesIO())
    b.add_file("a/b", b"")
    for path in ("A/B", "a", "a/b/c"):
        with pytest.raises(ValueError):
            b.add_file(path, b"")


def test_broken_archives_say_why(tmp_path):
    good = bytearray(built())
    cases = {"TooSmall": good[:FOOTER], "BadMagic": good[:-1], "LengthMismatch": b"x" + good}
    for at, code in ((-8, "UnsupportedVersion"), (-FOOTER, "SectionOutOfRange")):
        bad = bytearray(good)
        bad[at] ^= 0x7F
        cases[code] = bad
    for code, data in cases.items():
        with pytest.raises(OpenFailure) as e:
            Archive(io.BytesIO(bytes(data)))
        assert e.value.code == code
    assert open_failure(str(tmp_path / "none"))[1] == "FileNotFound"
    flipped = bytearray(good)
    flipped[100] ^= 1
    assert not Archive(io.BytesIO(bytes(flipped))).verify()


def test_a_broken_block_makes_a_read_short():
    data = bytearray(built({"r": random.Random(1).randbytes(3 * BLOCK)}, ()))
    a = Archive(io.BytesIO(bytes(data)))
    a.records[0] = (a.records[0][0], BLOCK - 1, 99, *a.records[0][3:])
    assert len(a.read(0, 3 * BLOCK)) == BLOCK


def test_pack_and_extract(spark, tmp_path):
    rows = [(p, bytearray(c)) for p, c in TREE.items()] + [("empty", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    target = f"{tmp_path}/t.zar"
    assert archives.pack(df, target) == target
    got = archives.entries(spark, target, content=True)
    assert {r.path: bytes(r.content) for r in got.where("is_file").collect()} == TREE
    archives.register(spark)
    source = spark.read.format("block_archive").load(target)
    assert {r.path: bytes(r.content) for r in source.where("is_file").collect()} == TREE
    assert spark.read.format("block_archive").option("content", "false").load(target).columns == [c for c in source.columns if c != "content"]
    df.coalesce(1).sortWithinPartitions("path").write.format("block_archive").mode("append").save(f"{tmp_path}/ds.zar")
    with open(f"{tmp_path}/ds.zar", "rb") as f:
        a = Archive(f)
        assert a.verify() and {e.path: a.read(e.offset, e.size) for e in a.entries() if e.is_file} == TREE
    parts = archives.entries(spark, target, content=True, partitionBytes=100_000)
    assert parts.rdd.getNumPartitions() > 1 and parts.where("is_file").count() == len(TREE)
    assert archives.extract(target, f"{tmp_path}/out") == (len(TREE), sum(map(len, TREE.values())))
    assert {p: open(f"{tmp_path}/out/{p}", "rb").read() for p in TREE} == TREE
    assert os.path.isdir(f"{tmp_path}/out/empty")
    back = archives.source(spark, f"{tmp_path}/out")
    again = f"{tmp_path}/again.zar"
    archives.pack(back, again)
    with open(target, "rb") as a, open(again, "rb") as b:
        assert sorted(e.path for e in Archive(a).entries()) == sorted(e.path for e in Archive(b).entries())
    with pytest.raises(FileExistsError):
        archives.pack(df, target)
    assert archives.pack(df, target, "Skip") is None
    assert archives.pack(df, target, "AutoRename") == f"{tmp_path}/t_1.zar"


def test_unsafe_names_are_not_extracted(tmp_path):
    for name in ("..", "con.txt", "C:x"):
        path = f"{tmp_path}/{len(name)}.zar"
        out = io.BytesIO()
        b = ArchiveBuilder(out)
        node = b._node("x", True)
        node["name"], node["offset"], node["size"] = name.encode(), 0, 1
        b.pending += b"x"
        b.name_order = {name.encode(): 0}
        b.finish()
        with open(path, "wb") as f:
            f.write(out.getvalue())
        with pytest.raises(ValueError, match="not safe"):
            archives.extract(path, f"{tmp_path}/out")


def test_batches_isolate_failures(spark, tmp_path):
    os.makedirs(f"{tmp_path}/one")
    with open(f"{tmp_path}/one/f", "wb") as f:
        f.write(b"data")
    items = [(f"{tmp_path}/one", f"{tmp_path}/one.zar"), (f"{tmp_path}/one", f"{tmp_path}/missing/x.zar")]
    rows = archives.batch(spark.createDataFrame(items, "source string, destination string"), "pack").collect()
    assert sorted(r.status for r in rows) == ["Completed", "Failed"]
    items = [(f"{tmp_path}/one.zar", f"{tmp_path}/back"), (f"{tmp_path}/none.zar", f"{tmp_path}/x")]
    rows = archives.batch(spark.createDataFrame(items, "source string, destination string"), "extract").collect()
    assert sorted((r.status, r.files) for r in rows) == [("Completed", 1), ("Failed", 0)]


KINDS = {
    "zeros": lambda n: bytes(n),
    "random": lambda n: random.Random(n).randbytes(n),
    "text": lambda n: (b"the quick brown fox jumps over the lazy dog. " * (n // 45 + 1))[:n],
    "pattern": pattern,
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_codec_round_trips(spark, kind):
    sizes = [0, 1, 2, 255, 1024, 65535, 65536, 66000]
    rows = [(n, bytearray(KINDS[kind](n))) for n in sizes] + [(None, None)]
    df = spark.createDataFrame(rows, "n int, raw binary")
    for name, options in (("zstd", {"level": 1}), ("zstd", {"level": 19, "checksum": True}), ("zstd-stream", {})):
        packed = df.withColumn("z", codec.compress(F.col("raw"), name, **options))
        back = packed.select("n", "raw", codec.decompress(F.col("z")).alias("plain"), codec.decompress_exact(F.col("z"), F.col("n")).alias("exact"))
        assert all(r.raw == r.plain == r.exact for r in back.collect())


def test_decoder_limits():
    z = zstandard.ZstdCompressor().compress(b"a" * 1000)
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert codec.decode_frames(z + skip + z) == b"a" * 2000
    with pytest.raises(zstandard.ZstdError):
        codec.decode_frames(z, most=999)
    for broken in (z[:-1], z[:3], skip[:-1], b"nothing"):
        with pytest.raises(zstandard.ZstdError):
            codec.decode_frames(broken)
    with pytest.raises(zstandard.ZstdError):
        codec.decode_exact(z, 999)
    d = b"the quick brown fox " * 100
    packed = codec.zstd_codec(6, dict_data=d)(b"the quick brown fox jumps")
    assert codec.decode_frames(packed, dict_data=d) == b"the quick brown fox jumps"


def test_code_page():
    every = bytes(range(256))
    assert latin.encode_1252(latin.decode_1252(every)) == every
    assert latin.encode_1252("€日𝄞") == b"\x80???"


def test_xxh64(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "b binary")
    got = df.select(codec.xxh64(F.col("b")).alias("zero"), codec.xxh64(F.col("b"), 42).alias("own"), F.lower(F.hex(F.xxhash64("b"))).alias("spark")).first()
    assert got.zero == xxhash.xxh64_hexdigest(b"abc", 0) and got.own == got.spark.rjust(16, "0")


@pytest.mark.parametrize("policy", ["fixed", "measured"])
def test_seekable_files(spark, policy):
    rng = random.Random(3)
    contents = {1: KINDS["text"](200_000), 2: b"", 3: rng.randbytes(300_000)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "key int, raw binary")
    make = seekable.fixed_frames if policy == "fixed" else seekable.measured_frames
    frames = make(df, "key", F.col("raw"), 8192)
    files = seekable.assemble(frames, "key")
    assert {r.key: bytes(r.content) for r in seekable.read_all(files, "key").collect()} == contents
    for at, n in ((0, 8192), (8000, 4000), (199_000, 1000)):
        got = seekable.read_range(files.where("key <> 2"), "key", at, n).collect()
        assert {r.key: bytes(r.content) for r in got} == {k: contents[k][at : at + n] for k in (1, 3)}
    counts = {r.key: r.n for r in seekable.table_of(files, "key").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert counts[2] == 1 and (policy != "fixed" or counts == {1: 25, 2: 1, 3: 37})
    apart = seekable.assemble(frames, "key", head=True)
    assert {r.key: bytes(r.content) for r in seekable.read_all(apart, "key", head="table").collect()} == contents
    with pytest.raises(Exception, match="past the end"):
        seekable.read_range(files.where("key = 1"), "key", 199_999, 2).collect()
