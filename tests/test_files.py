"""Whole files, settings, streams of entries and other small parts of the archive side."""

import io
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from cairn.functions import codec, matching, reports
from cairn.operators import batch, layout, seek
from cairn.plans import archives, files
from cairn.sources.archive import BLOCK, Archive, ArchiveBuilder, OpenFailure, open_failure

ITEMS = "source string, destination string"


def archive_of(tree, **options):
    out = io.BytesIO()
    b = ArchiveBuilder(out, **options)
    for p, c in tree.items():
        b.add_file(p, c)
    b.finish()
    return out.getvalue()


def test_entry_streams_seek_and_blocks_are_decoded_once(monkeypatch):
    rng = random.Random(1)
    tree = {f"f{i}": rng.randbytes(rng.randrange(5000)) for i in range(60)} | {"big": rng.randbytes(3 * BLOCK + 5)}
    a = Archive(archive_of(tree))
    decoded = []
    real = Archive._read
    monkeypatch.setattr(Archive, "_read", lambda self, at, n: decoded.append(at) or real(self, at, n))
    found = {e.path: e for e in a.entries()}
    for name, content in tree.items():
        assert a.open(found[name]).read() == content
    assert len(decoded) == len(set(decoded))
    s = a.open(found["big"])
    assert s.seek(-7, os.SEEK_END) == 3 * BLOCK - 2 and s.read() == tree["big"][-7:]
    assert s.seek(BLOCK - 3) and s.read(6) == tree["big"][BLOCK - 3 : BLOCK + 3] and s.tell() == BLOCK + 3
    assert Archive(archive_of(tree), cache_blocks=0).read(found["f3"].offset, found["f3"].size) == tree["f3"]


def test_builder_options():
    content = random.Random(2).randbytes(5 * BLOCK) + bytes(2 * BLOCK)
    one, four = (archive_of({"a": content, "b": b"x"}, parallelism=n) for n in (1, 4))
    assert one == four and Archive(four).verify()
    named = Archive(archive_of({"x/y": b"1", "b": b"2"}, names=["b", "y", "x"]))
    assert named.names == b"\1b\1y\1x"
    b = ArchiveBuilder(io.BytesIO())
    with pytest.raises(ValueError):
        b.add_directory("a/b", parents=False)
    b.add_directory("a", parents=False)
    b.add_directory("a/b", parents=False)
    b.add_file("a/c", b"12")
    b.append(b"34")
    assert b.last["size"] == 4


def test_open_failures_of_any_kind(tmp_path):
    class Dumb(io.RawIOBase):
        def readable(self):
            return True

    assert open_failure(Dumb())[1] == "InvalidStream" and open_failure("")[1] == "InvalidPath" and open_failure("a\0b")[1] == "InvalidPath"
    good = archive_of({"a": b"b"})
    assert open_failure(good)[1] == "None" and open_failure(io.BytesIO(good))[1] == "None"
    foot = len(good) - 144
    bad = bytearray(good)
    bad[foot + 40 : foot + 48] = (1).to_bytes(8, "big")
    assert open_failure(bytes(bad))[1] == "None"  # a name table may be cut; names are then missing
    path = tmp_path / "a.zar"
    path.write_bytes(good)
    assert open_failure(f"file://{path}")[1] == "None"
    assert open_failure(str(tmp_path))[0] is None


def test_huge_name_table(monkeypatch):
    monkeypatch.setattr("cairn.sources.archive.MAX_NAMES", 1)
    with pytest.raises(OpenFailure, match="BadNameTable"):
        Archive(archive_of({"abc": b"1"}))


def test_listing_and_prefix(spark, tmp_path):
    for name in ("b.iso", "a.ZIP", "c.txt", "z.zar"):
        (tmp_path / name).write_bytes(archive_of({"d/e": b"1", "f": b"2"}) if name == "z.zar" else b"")
    (tmp_path / "dir").mkdir()
    names = lambda mode: [os.path.basename(r.path) for r in files.processable(spark, str(tmp_path), mode).collect()]
    assert names("Auto") == ["a.ZIP", "b.iso", "dir"] and names("ExtractIso") == ["b.iso"] and names("Compress") == ["dir"]
    assert files.processable(spark, f"{tmp_path}/none").count() == 0
    got = archives.entries(spark, str(tmp_path), content=True, prefix="d").collect()
    assert [(r.path, r.content) for r in got] == [("d", None), ("d/e", b"1")]


def test_files_are_compressed_listed_and_decompressed(spark, tmp_path):
    contents = {"a": b"text " * 5000, "b": b"", "c": random.Random(1).randbytes(2_000_000)}
    for k, v in contents.items():
        (tmp_path / k).write_bytes(v)
    for sub, options in (("plain", {}), ("seek", {"frame_size": 4096}), ("dict", {"dict_data": b"text text " * 9})):
        os.makedirs(tmp_path / sub)
        items = spark.createDataFrame([(f"{tmp_path}/{k}", f"{tmp_path}/{sub}/{k}.zst") for k in contents], ITEMS)
        done = files.compress_files(items, **options).collect()
        assert all(r.status == "Completed" for r in done) and {r.bytes for r in done} == {len(v) for v in contents.values()}
        back = spark.createDataFrame([(f"{tmp_path}/{sub}/{k}.zst", f"{tmp_path}/{sub}/{k}") for k in contents], ITEMS)
        keep = {x: options[x] for x in options if x == "dict_data"}
        assert {r.status for r in files.decompress_files(back, **keep).collect()} == {"Completed"}
        assert {k: (tmp_path / sub / k).read_bytes() for k in contents} == contents
    seekable = spark.createDataFrame([(f"{tmp_path}/seek/{k}.zst",) for k in contents], "path string")
    listed = {os.path.basename(r.path): r for r in files.list_files(seekable).collect()}
    assert listed["a.zst"].n_frames == 7 and listed["b.zst"].n_frames == 1 and listed["c.zst"].total_decomp == 2_000_000
    rows = files.list_frames(seekable, first=1, last=2).collect()
    assert sorted((os.path.basename(r.path), r.frame_id, r.d_start) for r in rows if r.path.endswith("a.zst")) == [("a.zst", 1, 4096), ("a.zst", 2, 8192)]
    broken = files.tables(spark.createDataFrame([(f"{tmp_path}/plain/a.zst",)], "path string")).first()
    assert broken.failure == "BadMagic"


def test_failures_bounds_policies_and_stops(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1" * 5000)
    item = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/a.zst")], ITEMS)
    assert files.compress_files(item).first().status == "Completed"
    assert files.compress_files(item, policy="Skip").first().status == "Skipped"
    assert files.compress_files(item).first().status == "Failed"
    assert files.compress_files(item, policy="AutoRename").first().destination == f"{tmp_path}/a_1.zst"
    (tmp_path / "cut.zst").write_bytes((tmp_path / "a.zst").read_bytes()[:-2])
    cut = spark.createDataFrame([(f"{tmp_path}/cut.zst", f"{tmp_path}/cut")], ITEMS)
    assert files.decompress_files(cut).first().status == "Failed" and not os.path.exists(tmp_path / "cut")
    back = spark.createDataFrame([(f"{tmp_path}/a.zst", f"{tmp_path}/b")], ITEMS)
    assert files.decompress_files(back, most=4999).first().status == "Failed" and not os.path.exists(tmp_path / "b")
    (tmp_path / "stop").write_bytes(b"")
    assert files.decompress_files(back, stop=f"{tmp_path}/stop").first().status == "Cancelled"
    assert files.decompress_files(back, delete_source=True).first().status == "Completed" and not os.path.exists(tmp_path / "a.zst")
    os.makedirs(tmp_path / "tree")
    (tmp_path / "tree" / "x").write_bytes(b"x")
    items = spark.createDataFrame([(f"{tmp_path}/tree", f"{tmp_path}/tree.zar")], ITEMS)
    assert archives.batch(items, "pack", stop=f"{tmp_path}/stop").first().status == "Cancelled"
    assert archives.batch(items, "pack", delete_source=True).first().status == "Completed" and not os.path.exists(tmp_path / "tree")


def test_a_file_that_comes_meanwhile_is_kept(tmp_path):
    for policy, name in (("AutoRename", "w_1"), ("Overwrite", "w"), ("Skip", None)):
        (tmp_path / "w").write_bytes(b"theirs")
        (tmp_path / "t").write_bytes(b"ours")
        out = archives.place_file(str(tmp_path / "t"), str(tmp_path / "w"), policy)
        assert out == (name and str(tmp_path / name)) and (policy == "Overwrite") == ((tmp_path / "w").read_bytes() == b"ours")
    with pytest.raises(FileExistsError):
        archives.place_file(str(tmp_path / "t"), str(tmp_path / "w"), "Fail")


def test_settings_and_requests(spark, tmp_path):
    place = f"{tmp_path}/conf/settings.json"
    assert files.Settings.load(place) == files.Settings()
    files.Settings(workers=7, policy="Skip").save(place)
    assert files.Settings.load(place) == files.Settings(workers=7, policy="Skip")
    for text in ("{", "[]", '{"workers": "x", "policy": "None", "unknown": 1}'):
        with open(place, "w") as f:
            f.write(text)
        assert files.Settings.load(place) == files.Settings()
    request = files.Request(["/a/b", "/c"], "/out", keep_originals=False, policy="Skip", workers=2)
    assert request.options() == {"policy": "Skip", "delete_source": True}
    assert sorted(map(tuple, request.rows(spark).collect())) == [("/a/b", "/out/b.zar"), ("/c", "/out/c.zar")]


def test_frames_end_and_bounds():
    plain = zstandard.ZstdCompressor().compress(b"a" * 1000)
    assert codec.frame_end(plain + b"more") == len(plain) and codec.frame_end(plain[:-1]) is None
    with pytest.raises(zstandard.ZstdError):
        codec.frame_end(b"none of it")
    bomb = codec.zstd_stream_codec(3)(bytes(50_000_000))
    for f in (lambda: codec.decode_frames(bomb, most=1000), lambda: codec.StreamDecoder(most=1000).feed(bomb)):
        with pytest.raises(zstandard.ZstdError, match="exceeds"):
            f()
    with pytest.raises(zstandard.ZstdError, match="window"):
        codec.decode_frames(codec.zstd_codec(19)(random.Random(1).randbytes(300_000)), window=1 << 16)


def test_stream_decoder_does_not_depend_on_cuts():
    rng = random.Random(3)
    texts = [b"", b"line\n" * 9000, rng.randbytes(100_000)]
    raw = b"".join(codec.zstd_stream_codec(3)(t) + bytes.fromhex("502A4D1803000000616263") for t in texts)
    for step in (1, 7, 4096, len(raw)):
        d, out = codec.StreamDecoder(), b""
        for i in range(0, len(raw) if step > 1 else 3000, step):
            out += d.feed(raw[i : i + step])
            d = codec.StreamDecoder(d.state)
        assert b"".join(texts).startswith(out) and (step == 1 or out == b"".join(texts))
    with pytest.raises(zstandard.ZstdError):
        d = codec.StreamDecoder()
        d.feed(raw[:-5])
        d.close()


def named(wants, taken, ext):
    has, out = set(taken) if ext else {t.lower() for t in taken}, []
    for w in wants:
        (stem, e), n, fold = (os.path.splitext(w) if ext else (w, "")), 0, str if ext else str.lower
        choice = w
        while fold(choice) in has:
            n += 1
            choice = f"{stem}_{n}{e}"
        has.add(fold(choice))
        out.append(choice)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_names_never_clash(spark, seed):
    rng = random.Random(seed)
    pool = ["out", "OUT", "out_1", "out_2", "a", "a_1_1", "a_1", "b", "b_07", "c", "c_9"]
    wants, taken = [rng.choice(pool) for _ in range(60)], rng.sample(pool, seed)
    df = spark.createDataFrame(list(enumerate(wants)), "i bigint, wanted string").repartition(3)
    there = spark.createDataFrame([(x,) for x in taken], "path string")
    got = {r.i: (r.wanted, r.destination) for r in batch.claimed(df, F.col("wanted"), "i", there).collect()}
    assert [got[i] for i in range(60)] == list(zip(wants, named(wants, taken, False)))
    df, there = df.withColumn("wanted", F.concat("wanted", F.lit(".html"))), there.select(F.concat("path", F.lit(".html")).alias("path"))
    got = {r.i: r.free for r in batch.free_names(df, F.col("wanted"), "i", there).collect()}
    assert [got[i] for i in range(60)] == named([w + ".html" for w in wants], [t + ".html" for t in taken], True)


def test_ranges_of_keys_that_begin_alike(spark):
    df = spark.createDataFrame([(f"site/k/{i * 7919 % 20000}",) for i in range(20000)], "k string")
    cuts = layout.bounds(df, "k", 50)
    sizes = [r["count"] for r in df.groupBy(layout.range_of(F.col("k"), cuts, "string")).count().collect()]
    assert len(sizes) == len(cuts) + 1 == 50 and max(sizes) < 4 * 20000 / 50
    odd = ["", "site/k/5", "zz", None, cuts[0], cuts[-1], cuts[7], cuts[8] + "\0"]
    rows = spark.createDataFrame([(x,) for x in odd], "k string").select("k", layout.range_of(F.col("k"), cuts, "string").alias("r"))
    assert all(r.r == sum(c < r.k for c in cuts) if r.k is not None else r.r == 0 for r in rows.collect())
    keys = [1.5, float("nan"), -3.0, None, 7.25] * 20
    floats = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k double, i int")
    assert layout.running_total(floats, "k", F.lit(1), "n", ties=("i",)).select("n").distinct().count() == 100


def test_frames_of_each_file_have_their_own_table(spark):
    frames = spark.createDataFrame([("a", 0, 1, 10), ("a", 1, 1, 10), ("b", 0, 1, 5)], "f string, frame_id bigint, c_size bigint, d_size bigint")
    asked = spark.createDataFrame([("a", 12), ("b", 3), ("b", 12), ("c", 0)], "f string, offset bigint")
    got = seek.frame_at(asked, seek.seek_table(frames, ("f",)), within=("f",)).collect()
    assert sorted((r.f, r.offset, r.frame_id) for r in got) == [("a", 12, 1), ("b", 3, 0), ("b", 12, 0)]


def test_history_folds(spark):
    seqs = [(10, False), (1, False), (1, True), (3, True), (2, False)]
    h = [1, 4, 8]
    for o, z in seqs:
        if o > 3:
            h = [o - 3, h[0], h[1]]
        elif o - 1 + z:
            at = o - 1 + z
            h = [h[0] - 1 if at == 3 else h[at], h[0], h[1] if at >= 2 else h[2]]
    df = spark.createDataFrame([(seqs,)], "s array<struct<off_base:bigint,no_literals:boolean>>")
    assert df.select(matching.histories(F.col("s"))).first()[0] == h


def test_reports(spark):
    df = spark.createDataFrame([('a "b"\\\n\t\r\x01é',), ("",), (None,)], "t string")
    import json

    got = [r[0] for r in df.select(reports.json_string(F.col("t"))).collect()]
    assert [json.loads(x) if x else None for x in got] == ['a "b"\\\n\t\r\x01é', "", None]
    text = spark.createDataFrame([("user at C:\\Users\\user and c:/users/USER/x, users, user1",)], "t string")
    assert text.select(reports.sanitized(F.col("t"), "user", "C:\\Users\\user")).first()[0] == (
        "[user] at %USERPROFILE% and %USERPROFILE%/x, users, user1"
    )


def test_open_failures_keeps_archives_off_the_driver(spark, tmp_path, monkeypatch):
    import pickle

    from pyspark.sql import SparkSession

    from cairn.plans import queries

    given, create = [], SparkSession.createDataFrame
    pages = [(i, os.urandom(3000).hex()) for i in range(400)]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/some/pages.parquet")
    spark.createDataFrame([], "page_id bigint, html string").write.parquet(f"{tmp_path}/none/pages.parquet")

    def seen(self, data, *a, **b):
        given.append(len(pickle.dumps(data)))
        return create(self, data, *a, **b)

    monkeypatch.setattr(SparkSession, "createDataFrame", seen)
    for folder, least in (("some", 2), ("none", 1)):
        got = queries.open_failures(spark, f"{tmp_path}/{folder}").collect()
        assert sorted(map(tuple, got)) == list(enumerate(queries.FAILURES))
        made = queries.page_archives(spark, f"{tmp_path}/{folder}").select("part", "data").collect()
        assert len(made) >= least and max(len(r.data) for r in made) < 3 << 20
    assert sum(given) < 10_000
    # every page is in one of the archives, whole
    made = queries.page_archives(spark, f"{tmp_path}/some").withColumn("part", F.col("part").cast("string"))
    found = archives.entries_in(made, "part", "data", content=True).where("is_file AND path <> 'part.txt'").collect()
    assert sorted(bytes(r.content).decode() for r in found) == sorted(h for _, h in pages)
