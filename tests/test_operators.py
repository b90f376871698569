from pyspark.sql import functions as F

from cairn.operators import layout, seek, stats, tree


def test_running_total_does_not_depend_on_partitions(spark):
    rows = [(i * 7 % 1000, i % 13) for i in range(1000)]
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total
        total += v
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(rows, "k bigint, v int").repartition(n)
        got = layout.running_total(df, "k", F.col("v"), "at")
        assert {r.k: r.at for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_running_total_within_groups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 5), ("b", "z", 7)], "g string, k string, v int")
    got = layout.running_total(df, "k", F.col("v"), "at", ("g",))
    assert {(r.g, r.k): r.at for r in got.collect()} == {("a", "x"): 0, ("a", "y"): 1, ("b", "x"): 0, ("b", "z"): 5}


def test_seek_table_defects(spark):
    table = spark.createDataFrame([(0, 10, 20), (1, 5, 0), (2, 7, 30)], "frame_id bigint, c_size bigint, d_size bigint")
    good = bytes(seek.serialize(table).first().table)
    cases = {
        None: good,
        "TooShort": good[-8:],
        "BadMagic": good[:-1] + b"\0",
        "ReservedBits": good[:-5] + b"\x04" + good[-4:],
        "Truncated": good[1:],
        "BadSkippableMagic": b"\0" + good[1:],
        "SizeMismatch": good[:4] + b"\0" + good[5:],
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "want string, data binary")
    for r in seek.parse(df).collect():
        assert r.failure == r.want
        assert [tuple(f) for f in r.frames] == ([(0, 10, 20), (1, 5, 0), (2, 7, 30)] if r.want is None else [])


def test_offsets_past_the_end_find_the_last_frame(spark):
    table = seek.seek_table(spark.createDataFrame([(0, 1, 10), (1, 1, 0), (2, 1, 5)], "frame_id bigint, c_size bigint, d_size bigint"))
    asked = spark.createDataFrame([(x,) for x in (0, 9, 10, 14, 15, 99)], "offset bigint")
    got = {r.offset: r.frame_id for r in seek.frame_at(asked, table, bin_size=4).collect()}
    assert got == {0: 0, 9: 0, 10: 2, 14: 2, 15: 2, 99: 2}
    assert seek.frame_at(asked, table.limit(0)).count() == 0


def test_breadth_first_order(spark):
    paths = ["b/x", "a/z", "a/y/q", "A/w", "a b/c", "c"]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, n int")
    got = tree.breadth_first(tree.nodes(files, F.col("path"), F.col("n"))).orderBy("node_id").collect()
    assert [r.folded for r in got] == ["", "a", "a b", "b", "c", "a/w", "a/y", "a/z", "a b/c", "b/x", "a/y/q"]
    by = {r.folded: (r.child_start, r.child_count) for r in got}
    assert by[""] == (1, 4) and by["a"] == (5, 3) and by["a b"] == (8, 1) and by["a/y"] == (10, 1) and by["c"] == (None, None)


def test_uniform_payloads(spark):
    df = spark.createDataFrame([(1, bytearray(b"aaaa")), (2, bytearray(b"ab")), (3, bytearray())], "k int, b binary")
    got = stats.is_uniform(stats.byte_rows(df, "k", F.col("b")), "k").collect()
    assert {r.k: r.uniform for r in got} == {1: True, 2: False}
