"""Registered queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import codec, latin, matching, parsing, paths, reports
from cairn.functions.binary import be_bytes, be_uint, le_bytes, le_uint, low_high, within
from cairn.operators import batch, layout, seek, stats, tree
from cairn.plans import archives, files, seekable
from cairn.sources.archive import at
from cairn.streaming import frames as streams

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def n_bytes() -> Column:
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")


SZ = "octet_length(encode(coalesce(text, '')))"
LAYOUT = f"""l AS (SELECT doc_id, {SZ}::BIGINT AS sz,
  coalesce(sum({SZ}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM documents)"""


@query(f"WITH {LAYOUT} SELECT doc_id, sz AS size, off AS \"offset\" FROM l")
def layout_offsets(spark, sf_dir):
    return layout.file_layout(docs(spark, sf_dir), "doc_id", n_bytes()).select("doc_id", "size", "offset")


@query(f"""WITH {LAYOUT}, b AS (SELECT *, unnest(range(off // 65536, (off + sz - 1) // 65536 + 1)) AS block_id FROM l WHERE sz > 0)
SELECT block_id::BIGINT AS block_id, count(*)::BIGINT AS n_files,
  sum(least(off + sz, (block_id + 1) * 65536) - greatest(off, block_id * 65536))::BIGINT AS used_bytes FROM b GROUP BY block_id""")
def block_fanout(spark, sf_dir):
    return layout.block_fanout(layout.file_layout(docs(spark, sf_dir), "doc_id", n_bytes()))


@query(f"""WITH {LAYOUT}, b AS (SELECT *, unnest(range(off // 4096, (off + sz - 1) // 4096 + 1))::BIGINT AS b FROM l WHERE sz > 0)
SELECT doc_id, b AS block_id, greatest(off, b * 4096) - b * 4096 AS in_block, greatest(off, b * 4096) - off AS in_file,
  least(off + sz, (b + 1) * 4096) - greatest(off, b * 4096) AS length FROM b""")
def block_overlap(spark, sf_dir):
    got = layout.block_overlap(layout.file_layout(docs(spark, sf_dir), "doc_id", n_bytes()), 4096)
    return got.select("doc_id", "block_id", "in_block", "in_file", "length")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def doc_sha256(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


HEX = "unnest(regexp_extract_all(hex(encode(text)), '..'))"


@query(f"WITH b AS (SELECT {HEX} AS h FROM documents) SELECT ('0x' || h)::INT AS byte, count(*)::BIGINT AS n FROM b GROUP BY h")
def byte_histogram(spark, sf_dir):
    return stats.histogram(docs(spark, sf_dir), F.col("text").cast("binary"))


COUNTS = f"""b AS (SELECT doc_id, {HEX} AS h FROM documents),
c AS (SELECT doc_id, h, count(*) AS n FROM b GROUP BY doc_id, h)"""


@query(f"WITH {COUNTS} SELECT doc_id, count(*)::BIGINT AS n_symbols, max(n)::BIGINT AS largest, sum(n)::BIGINT AS total FROM c GROUP BY doc_id")
def alphabet_cardinality(spark, sf_dir):
    return stats.cardinality(stats.byte_rows(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary")), "doc_id")


@query(f"WITH {COUNTS} SELECT doc_id, count(*) = 1 AS uniform FROM c GROUP BY doc_id")
def uniform_payloads(spark, sf_dir):
    return stats.is_uniform(stats.byte_rows(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary")), "doc_id")


@query(f"""WITH {COUNTS}, t AS (SELECT doc_id, sum(n) AS total, sum(n * ln(n)) AS s FROM c GROUP BY doc_id)
SELECT doc_id, total::BIGINT AS total, round((total * ln(total) - s) / ln(2.0) / total, 6) AS bits_per_byte FROM t""")
def payload_entropy(spark, sf_dir):
    got = stats.entropy(stats.byte_rows(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary")), "doc_id")
    return got.select("doc_id", "total", F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query(f"""WITH {COUNTS}, t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
s AS (SELECT doc_id, n, greatest(256 * n // total, 1) AS share FROM c JOIN t USING (doc_id))
SELECT doc_id, (sum(n * floor(256 * log2(256.0 / share))::BIGINT) // 256)::BIGINT AS cost_bits FROM s GROUP BY doc_id""")
def table_cost(spark, sf_dir):
    return stats.table_cost(stats.byte_rows(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary")), "doc_id")


@query(f"""WITH {COUNTS}, g AS (SELECT h, sum(n) AS n FROM c GROUP BY h), m AS (SELECT sum(n) AS t FROM g),
w AS (SELECT h, greatest(1, (256 * n // t)::BIGINT) AS share FROM g, m)
SELECT doc_id, (sum(c.n * floor(256 * log2(256.0 / share))::BIGINT) // 256)::BIGINT AS cost_bits FROM c JOIN w USING (h) GROUP BY doc_id""")
def cross_cost(spark, sf_dir):
    data = F.col("text").cast("binary")
    rows = docs(spark, sf_dir)
    all_ = stats.histogram(rows, data)
    total = all_.agg(F.sum("n").alias("t"))
    share = F.greatest(F.lit(1), F.floor(256 * F.col("n") / F.col("t")).cast("int"))
    norm = all_.join(F.broadcast(total)).select("byte", share.alias("share"))  # one row
    return stats.cross_cost(stats.byte_rows(rows, "doc_id", data), norm, "doc_id", 8)


@query(f"""WITH {COUNTS} SELECT doc_id, (sum(n * (4 + (('0x' || h)::INT % 5))) // 8)::BIGINT AS coded_bytes FROM c GROUP BY doc_id""")
def coded_size(spark, sf_dir):
    lengths = spark.range(256).select(F.col("id").cast("int").alias("byte"), (4 + F.col("id") % 5).alias("bits"))
    counts = stats.byte_rows(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary"))
    return stats.coded_size(counts, lengths, "doc_id")


FP = """h AS (SELECT {key}, hex(encode({col})) AS x FROM {t} WHERE octet_length(encode({col})) >= 2),
p AS (SELECT {key}, length(x) // 2 AS n, x, unnest(range(0, length(x) // 2 - 1, 5)) AS i FROM h),
b AS (SELECT {key}, (n - 1) // 5 AS events, ((('0x' || substr(x, 2 * i + 1, 2))::BIGINT + 256 * ('0x' || substr(x, 2 * i + 3, 2))::BIGINT)
  * 2654435769 % 4294967296) >> 24 AS bucket FROM p)"""


@query("WITH " + FP.format(key="doc_id", col="text", t="documents") + " SELECT doc_id, bucket::INT AS bucket, count(*)::BIGINT AS n, max(events)::BIGINT AS events FROM b GROUP BY doc_id, bucket")
def fingerprint_events(spark, sf_dir):
    return stats.fingerprints(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary"), 5, 8)


@query("WITH " + FP.format(key="doc_id", col="text", t="documents") + """, f AS (SELECT doc_id, bucket, count(*) AS n, max(events) AS e FROM b GROUP BY doc_id, bucket),
l AS (SELECT doc_id AS k, bucket, n, e FROM f), r AS (SELECT doc_id + 1 AS k, bucket, n, e FROM f),
el AS (SELECT k, max(e) AS ea FROM l GROUP BY k), er AS (SELECT k, max(e) AS eb FROM r GROUP BY k),
j AS (SELECT k, bucket, coalesce(l.n, 0) AS na, coalesce(r.n, 0) AS nb FROM l FULL JOIN r USING (k, bucket))
SELECT k AS doc_id, sum(abs(na * eb - nb * ea))::BIGINT AS distance FROM j JOIN el USING (k) JOIN er USING (k) GROUP BY k""")
def fingerprint_distance(spark, sf_dir):
    prints = stats.fingerprints(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary"), 5, 8)
    return stats.distance(prints, prints.withColumn("doc_id", F.col("doc_id") + 1), "doc_id")


@query("WITH " + FP.format(key="doc_id", col="text", t="documents") + ", f AS (SELECT doc_id, bucket, count(*) AS n, max(events) AS e FROM b GROUP BY doc_id, bucket) SELECT bucket::INT AS bucket, sum(n)::BIGINT AS n, sum(e)::BIGINT AS events FROM f GROUP BY bucket")
def fingerprint_merge(spark, sf_dir):
    return stats.merged(stats.fingerprints(docs(spark, sf_dir), "doc_id", F.col("text").cast("binary"), 5, 8))


@query(f"SELECT count(*)::BIGINT AS n_entries, count(*)::BIGINT AS n_files, sum({SZ})::DECIMAL(38,0) AS n_bytes FROM documents")
def total_bytes(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.lit(True).alias("is_file"), F.coalesce(n_bytes(), F.lit(0)).alias("size"))
    return tree.totals(rows)


UP, LOW = paths.UPPER, paths.LOWER


@query(f"SELECT page_id, translate(url, '{UP}', '{LOW}') AS folded, translate(url, '{UP}', '{LOW}') = translate(upper(url), '{UP}', '{LOW}') AS same FROM pages")
def ascii_fold(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", paths.fold(F.col("url")).alias("folded"), paths.same_name(F.col("url"), F.upper("url")).alias("same")
    )


PARTS = r"list_filter(regexp_split_to_array(url, '[/\\]'), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT {PARTS} AS c, octet_length(encode(html))::BIGINT AS sz FROM pages),
d AS (SELECT c, sz, unnest(range(0, len(c))) AS k FROM p)
SELECT array_to_string(c[1:k], '/') AS directory, count(*)::BIGINT AS n_files, sum(sz)::BIGINT AS n_bytes FROM d GROUP BY 1""")
def dir_rollup(spark, sf_dir):
    return tree.directory_rollup(read(spark, sf_dir, "pages"), F.col("url"), F.octet_length("html"))


@query(rf"""SELECT page_id, ({PARTS})[1] AS node, regexp_extract(url, '([^/\\]*)$', 1) AS filename,
regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1) AS directory, len({PARTS})::INT AS n_parts FROM pages""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    name = paths.split_filename(url)
    return read(spark, sf_dir, "pages").select(
        "page_id",
        paths.next_node(url)["node"].alias("node"),
        name["filename"].alias("filename"),
        name["directory"].alias("directory"),
        F.size(paths.components(url)).alias("n_parts"),
    )


NODES = f"""p AS (SELECT list_transform({PARTS}, lambda x: translate(x, '{UP}', '{LOW}')) AS c FROM pages),
n AS (SELECT DISTINCT array_to_string(c[1:k], '/') AS path, k AS depth, array_to_string(c[1:k-1], '/') AS parent, c[k] AS name
  FROM (SELECT c, unnest(range(1, len(c) + 1)) AS k FROM p))"""


def page_tree(spark, sf_dir):
    return tree.nodes(read(spark, sf_dir, "pages"), F.col("url"), F.octet_length("html"))


@query(f"""WITH RECURSIVE {NODES}, kids AS (SELECT parent, count(*)::BIGINT AS n FROM n GROUP BY parent),
o AS (SELECT path, parent, depth, name FROM n UNION ALL SELECT '', NULL, 0, ''),
r AS (SELECT ''::VARCHAR AS path, ''::VARCHAR AS ord, 0::BIGINT AS depth UNION ALL
  SELECT n.path, r.ord || chr(1) || n.name, n.depth::BIGINT FROM n JOIN r ON n.parent = r.path AND n.depth = r.depth + 1)
SELECT r.path AS folded, (row_number() OVER (ORDER BY r.depth, r.ord) - 1)::BIGINT AS node_id, coalesce(kids.n, 0)::BIGINT AS n_children
FROM r LEFT JOIN kids ON kids.parent = r.path""")
def bfs_numbering(spark, sf_dir):
    got = tree.breadth_first(page_tree(spark, sf_dir))
    return got.select("folded", "node_id", F.coalesce("child_count", F.lit(0)).alias("n_children"))


RANKED = """r AS (SELECT ''::VARCHAR AS path, ''::VARCHAR AS ord, 0::BIGINT AS depth UNION ALL
  SELECT n.path, r.ord || chr(1) || n.name, n.depth::BIGINT FROM n JOIN r ON n.parent = r.path AND n.depth = r.depth + 1),
i AS (SELECT path, (row_number() OVER (ORDER BY depth, ord) - 1)::BIGINT AS node_id FROM r)"""


@query(f"""WITH RECURSIVE {NODES}, {RANKED} SELECT parent AS folded, count(*)::BIGINT AS child_count, min(node_id)::BIGINT AS child_start
FROM n JOIN i USING (path) GROUP BY parent""")
def dir_children(spark, sf_dir):
    got = tree.breadth_first(page_tree(spark, sf_dir))
    return got.where("child_count > 0").select("folded", "child_count", "child_start")


@query(f"""WITH {NODES}, d AS (SELECT name, min(path) AS first FROM n GROUP BY name),
o AS (SELECT name, coalesce(sum(octet_length(encode(name)) + CASE WHEN octet_length(encode(name)) >= 128 THEN 2 ELSE 1 END)
  OVER (ORDER BY first, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS name_id FROM d)
SELECT path AS folded, name_id, hex(encode(name)) AS raw FROM n JOIN o USING (name)""")
def node_names(spark, sf_dir):
    """The bytes of each node's name by its place in the name table."""
    nodes = page_tree(spark, sf_dir).select("folded", F.element_at(paths.components(F.col("folded")), -1).alias("name"))
    table = tree.name_table(nodes, F.col("name"), "folded")
    ids = nodes.join(table.select("name", F.col("offset").alias("name_id")), "name").select("folded", "name_id")
    return tree.names_of(ids, table).select("folded", "name_id", F.hex("raw").alias("raw"))


@query(f"WITH {NODES} SELECT path AS folded FROM n WHERE parent = ''")
def root_entries(spark, sf_dir):
    return tree.children(tree.breadth_first(page_tree(spark, sf_dir)), F.lit(0)).select("folded")


@query(f"""WITH RECURSIVE {NODES}, r AS (SELECT ''::VARCHAR AS path, ''::VARCHAR AS ord, 0::BIGINT AS depth UNION ALL
  SELECT n.path, r.ord || chr(1) || n.name, n.depth::BIGINT FROM n JOIN r ON n.parent = r.path AND n.depth = r.depth + 1),
i AS (SELECT path, (row_number() OVER (ORDER BY depth, ord) - 1)::BIGINT AS node_id FROM r)
SELECT page_id, i.path AS found, node_id FROM pages JOIN i ON i.path = array_to_string(list_transform({PARTS}, lambda x: translate(x, '{UP}', '{LOW}')), '/')""")
def path_lookup(spark, sf_dir):
    """Pages by their paths in capitals."""
    numbered = tree.breadth_first(page_tree(spark, sf_dir))
    asked = read(spark, sf_dir, "pages").select("page_id", F.upper("url").alias("url"))
    found = tree.lookup(asked, numbered, "url")
    return found.join(numbered.select("node_id", "folded"), "node_id").select("page_id", F.col("folded").alias("found"), "node_id")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY encode(translate(p_name, '{UP}', '{LOW}')), p_partkey) AS place FROM part")
def sibling_order(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", UP, LOW).alias("name"))
    got = layout.running_total(parts, "name", F.lit(1), "before", ties=("p_partkey",))
    return got.select("p_partkey", (F.col("before") + 1).alias("place"))


@query("""WITH d AS (SELECT p_type AS name, min(p_partkey) AS first FROM part GROUP BY p_type)
SELECT name, first, (coalesce(sum(octet_length(encode(name)) + CASE WHEN octet_length(encode(name)) >= 128 THEN 2 ELSE 1 END)
  OVER (ORDER BY first, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM d""")
def name_offsets(spark, sf_dir):
    return tree.name_table(read(spark, sf_dir, "part"), F.col("p_type"), "p_partkey")


BLOCKS = f"b AS (SELECT doc_id AS block_id, least(greatest({SZ}, 1), 65536)::BIGINT AS stored FROM documents)"


def sized_blocks(spark, sf_dir):
    stored = layout.stored_size(F.greatest(n_bytes(), F.lit(1)))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("block_id"), stored.alias("stored"))


@query(f"""WITH {BLOCKS}, o AS (SELECT *, coalesce(sum(stored) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM b)
SELECT block_id // 16 AS record_id, min("at")::BIGINT AS base, string_agg((stored - 1)::VARCHAR, ',' ORDER BY block_id) || repeat(',0', (16 - count(*))::INT) AS sizes
FROM o GROUP BY block_id // 16""")
def offset_records(spark, sf_dir):
    got = layout.offset_records(sized_blocks(spark, sf_dir))
    return got.select("record_id", "base", F.array_join("sizes", ",").alias("sizes"))


@query(f"""WITH {BLOCKS} SELECT block_id, coalesce(sum(stored) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at", stored FROM b""")
def block_offsets(spark, sf_dir):
    blocks = sized_blocks(spark, sf_dir)
    got = layout.block_offsets(layout.offset_records(blocks))
    return got.join(blocks.select("block_id"), "block_id", "left_semi")


FRAMES = f"""f AS (SELECT doc_id, {SZ}::BIGINT AS sz, unnest(range(0, greatest(1, ({SZ} + 4095) // 4096)))::BIGINT AS k FROM documents),
g AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS frame_id, doc_id, k, least(sz - k * 4096, 4096) AS d_size,
  least(sz - k * 4096, 4096) // 2 + 10 AS c_size FROM f),
s AS (SELECT frame_id, c_size, d_size, (sum(c_size) OVER w - c_size)::BIGINT AS c_start, (sum(d_size) OVER w - d_size)::BIGINT AS d_start
  FROM g WINDOW w AS (ORDER BY frame_id ROWS UNBOUNDED PRECEDING))"""


def frames(spark, sf_dir):
    got = seek.numbered_frames(docs(spark, sf_dir), "doc_id", n_bytes(), 4096)
    d = F.col("d_size").cast("bigint")
    return got.select("frame_id", d.alias("d_size"), (F.floor(d / 2) + 10).cast("bigint").alias("c_size"))


@query(f"WITH {FRAMES} SELECT *, c_start + c_size AS c_end, d_start + d_size AS d_end FROM s")
def seek_table(spark, sf_dir):
    return seek.seek_table(frames(spark, sf_dir))


@query(f"WITH {FRAMES} SELECT frame_id, c_size, d_size FROM s")
def frame_sizes(spark, sf_dir):
    table = seek.seek_table(frames(spark, sf_dir))
    return seek.frame_sizes(table.select("frame_id", "c_end", "d_end")).select("frame_id", "c_size", "d_size")


@query(f"""WITH {FRAMES}, t AS (SELECT max(d_start + d_size) AS total, max(frame_id) AS last FROM s),
q AS (SELECT o_orderkey, (o_orderkey * 7919 % (SELECT total + 5000 FROM t))::BIGINT AS "offset" FROM orders)
SELECT o_orderkey, q."offset", coalesce(s.frame_id, t.last)::BIGINT AS frame_id FROM q CROSS JOIN t
LEFT JOIN s ON s.d_size > 0 AND q."offset" >= s.d_start AND q."offset" < s.d_start + s.d_size""")
def seek_lookup(spark, sf_dir):
    table = seek.seek_table(frames(spark, sf_dir))
    total = table.agg(F.max("d_end").alias("total"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(total))  # one row
    asked = orders.select("o_orderkey", (F.col("o_orderkey") * 7919 % (F.col("total") + 5000)).alias("offset"))
    return seek.frame_at(asked, table, bin_size=1 << 16)


@query(f"""WITH {FRAMES} SELECT count(*)::BIGINT AS n_frames, sum(c_size)::BIGINT AS total_comp, sum(d_size)::BIGINT AS total_decomp,
max(c_size)::BIGINT AS max_comp, max(d_size)::BIGINT AS max_decomp, sum(d_size)::DOUBLE / sum(c_size)::DOUBLE AS ratio FROM s""")
def seek_list_summary(spark, sf_dir):
    return seek.summary(frames(spark, sf_dir))


@query(f"""WITH {FRAMES} SELECT frame_id, greatest(d_start, 100000) - d_start AS skip,
least(d_start + d_size, 150000) - greatest(d_start, 100000) AS take FROM s WHERE d_start < 150000 AND d_start + d_size > 100000""")
def frame_range(spark, sf_dir):
    got = seek.frame_range(seek.seek_table(frames(spark, sf_dir)), 100_000, 50_000)
    return got.select("frame_id", "skip", "take")


@query(f"WITH {FRAMES} SELECT frame_id, c_size, d_size FROM s WHERE frame_id BETWEEN 10 AND 29")
def frame_rows(spark, sf_dir):
    return frames(spark, sf_dir).where("frame_id BETWEEN 10 AND 29").select("frame_id", "c_size", "d_size")


@query(f"WITH {FRAMES} SELECT count(*)::BIGINT AS n, sum(c_size)::BIGINT AS c, sum(d_size)::BIGINT AS d, true AS same FROM s")
def seek_table_bytes(spark, sf_dir):
    table = frames(spark, sf_dir)
    foot, head = seek.serialize(table), seek.serialize(table, head=True)
    one = seek.parse(foot.select(F.col("table").alias("data"))).select("frames", "failure")
    two = seek.parse(head.select(F.col("table").alias("data")), head=True).select(F.col("frames").alias("again"))
    both = one.join(two)  # one row each
    total = lambda c: F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, f: a + f[c])
    same = (F.col("frames") == F.col("again")) & F.col("failure").isNull()
    return both.select(
        F.size("frames").cast("bigint").alias("n"), total("c_size").alias("c"), total("d_size").alias("d"), same.alias("same")
    )


ODD_NAMES = ["a.txt", "..", ".", "", "con", "COM1.log", "com10", "lpt9", "x/y", "a\\b", "C:evil", "nul.tar.gz", "console", "É.txt"]
ODD_LIST = "['a.txt', '..', '.', '', 'con', 'COM1.log', 'com10', 'lpt9', 'x/y', 'a\\b', 'C:evil', 'nul.tar.gz', 'console', 'É.txt']"
NAMED = f"""n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN ({ODD_LIST})[(c_custkey // 3 % 14 + 1)::INT]
  ELSE ({ODD_LIST})[(c_custkey // 3 % 14 + 1)::INT] || c_custkey END AS name FROM customer)"""


def picked(values: list[str], number: Column) -> Column:
    """One of some values, by a number."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(rf"""WITH {NAMED} SELECT c_custkey, name,
NOT (name = '' OR name IN ('.', '..') OR regexp_matches(name, '[/\\]') OR regexp_matches(name, '^[A-Za-z]:')
  OR regexp_matches(upper(split_part(name, '.', 1)), '^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$')) AS safe FROM n""")
def unsafe_names(spark, sf_dir):
    k = F.col("c_custkey")
    odd = picked(ODD_NAMES, F.floor(k / 3))
    name = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, odd).otherwise(F.concat(odd, k))
    rows = read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return rows.select("c_custkey", "name", paths.is_safe_name(F.col("name")).alias("safe"))


UNITS = ["", "b", "K", "KiB", " m", "MiB", "g", "Gib", "Q", "x1", "000000000000000000M"]


@query(rf"""WITH t AS (SELECT o_orderkey, o_orderkey || ({sql_list(UNITS)})[(o_orderkey % 11 + 1)::INT] AS text FROM orders
  UNION ALL SELECT -i, ({sql_list(["18446744073709551615", "18446744073709551616", "20000000000000G", "", "-5", "007k"])})[i] FROM range(1, 7) r(i)),
p AS (SELECT *, try_cast(regexp_extract(text, '^([0-9]+)', 1) AS HUGEINT) AS n, upper(regexp_replace(regexp_replace(text, '^[0-9]+', ''), '\s', '', 'g')) AS u FROM t),
s AS (SELECT o_orderkey, text, n * CASE u WHEN '' THEN 1 WHEN 'B' THEN 1 WHEN 'K' THEN 1024 WHEN 'KIB' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'MIB' THEN 1048576
  WHEN 'G' THEN 1073741824 WHEN 'GIB' THEN 1073741824 END AS size FROM p)
SELECT o_orderkey, text, CASE WHEN size <= 18446744073709551615 THEN size::DECIMAL(38,0) END AS size FROM s""")
def byte_size_parse(spark, sf_dir):
    odd = ["18446744073709551615", "18446744073709551616", "20000000000000G", "", "-5", "007k"]
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(k, picked(UNITS, k)).alias("text"))
    more = spark.createDataFrame([(-i - 1, x) for i, x in enumerate(odd)], "o_orderkey bigint, text string")
    return rows.unionByName(more).select("o_orderkey", "text", parsing.byte_size(F.col("text")).alias("size"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 250 || '% done' WHEN 1 THEN 'at ' || event_id || ' of 9: ' || event_id % 101 || '%'
  WHEN 2 THEN 'no share of ' || event_id ELSE '% ' || event_id % 50 || '%%' END AS line FROM events)
SELECT event_id, line, CASE WHEN regexp_extract(line, '([0-9]+)%', 1) <> '' THEN least(regexp_extract(line, '([0-9]+)%', 1)::BIGINT / 100.0, 1.0)::DOUBLE END AS share FROM t""")
def percent_parse(spark, sf_dir):
    e = F.col("event_id")
    line = (
        F.when(e % 4 == 0, F.concat(e % 250, F.lit("% done")))
        .when(e % 4 == 1, F.concat(F.lit("at "), e, F.lit(" of 9: "), e % 101, F.lit("%")))
        .when(e % 4 == 2, F.concat(F.lit("no share of "), e))
        .otherwise(F.concat(F.lit("% "), e % 50, F.lit("%%")))
    )
    rows = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", "line", parsing.percent(F.col("line")).cast("double").alias("share"))


MODE_WORDS = ["auto", " Extract-Arc ", "archive", "ISO", "extract", "compress", "pack", "", "extract-iso", "Extract-Archive"]
MODE_SQL = """CASE lower(trim(word)) WHEN 'auto' THEN 'Auto' WHEN 'extract-archive' THEN 'ExtractArchive' WHEN 'extract-arc' THEN 'ExtractArchive'
  WHEN 'archive' THEN 'ExtractArchive' WHEN 'extract-iso' THEN 'ExtractIso' WHEN 'extract' THEN 'ExtractIso' WHEN 'iso' THEN 'ExtractIso' WHEN 'compress' THEN 'Compress' END"""
SUFFIXES = [".iso", ".ISO", ".zip", ".rar", ".7z", ".tar", ".gz", ".zar", "", ".iso.txt"]
ENTRIES = f"""e AS (SELECT event_id, ({sql_list(MODE_WORDS)})[(event_id % 10 + 1)::INT] AS word, 'dir.d/f' || event_id || ({sql_list(SUFFIXES)})[(event_id // 10 % 10 + 1)::INT] AS path,
  event_id % 7 = 0 AS is_dir FROM events), m AS (SELECT *, {MODE_SQL} AS mode, lower(regexp_extract(path, '[^/\\\\]*?(\\.[^./\\\\]+)$', 1)) AS x FROM e),
k AS (SELECT *, x = '.iso' AS iso, x IN ('.zip', '.rar', '.7z', '.tar', '.gz') AS arc FROM m)"""


def entries_of_modes(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    path = F.concat(F.lit("dir.d/f"), e, picked(SUFFIXES, F.floor(e / 10)))
    rows = read(spark, sf_dir, "events").select("event_id", picked(MODE_WORDS, e).alias("word"), path.alias("path"), (e % 7 == 0).alias("is_dir"))
    return rows.withColumns({"mode": parsing.process_mode(F.col("word")), "suffix": paths.extension(F.col("path"))})


@query(f"WITH {ENTRIES} SELECT event_id, word, mode FROM k")
def process_modes(spark, sf_dir):
    return entries_of_modes(spark, sf_dir).select("event_id", "word", "mode")


@query(f"""WITH {ENTRIES} SELECT event_id, CASE mode WHEN 'Auto' THEN is_dir OR iso OR arc WHEN 'ExtractArchive' THEN NOT is_dir AND arc
  WHEN 'ExtractIso' THEN NOT is_dir AND iso WHEN 'Compress' THEN is_dir ELSE false END AS taken,
CASE WHEN is_dir THEN 'directory' WHEN iso THEN 'iso' ELSE 'archive' END AS kind,
CASE WHEN mode <> 'Auto' THEN 'all' WHEN is_dir THEN 'directory' WHEN arc THEN 'archive' WHEN iso THEN 'iso' ELSE 'directory' END AS stages FROM k""")
def processable_entries(spark, sf_dir):
    is_dir, x = F.col("is_dir"), F.col("suffix")
    return entries_of_modes(spark, sf_dir).select(
        "event_id",
        parsing.accepts(F.col("mode"), x, ~is_dir, is_dir).alias("taken"),
        parsing.input_kind(is_dir, x).alias("kind"),
        parsing.stage_kind(F.col("mode"), is_dir, x).alias("stages"),
    )


@query(f"WITH {ENTRIES} SELECT event_id % 97 AS tree, min(path) FILTER (iso) AS first FROM k GROUP BY 1")
def first_images(spark, sf_dir):
    rows = entries_of_modes(spark, sf_dir).withColumn("tree", F.col("event_id") % 97)
    return files.first_image(rows, "path", ("tree",))


OUTSIDE = ["a/b", "../a", "a/../b", "/etc", "\\x", "C:x", "a..b", "..", "a\\..\\b", "", "b/.."]


@query(rf"""WITH p AS (SELECT page_id, ({sql_list(OUTSIDE)})[(page_id % 11 + 1)::INT] || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' || page_id END AS path FROM pages)
SELECT page_id, NOT (regexp_matches(path, '^[/\\]|^[A-Za-z]:') OR list_contains(regexp_split_to_array(path, '[/\\]'), '..')) AS inside FROM p""")
def inside_root(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(picked(OUTSIDE, k), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("/"), k)))
    return read(spark, sf_dir, "pages").select("page_id", paths.stays_inside(path).alias("inside"))


@query(r"""WITH p AS (SELECT page_id, 'games/v' || page_id % 9 || '.' || page_id || CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '.zar' WHEN 2 THEN '' ELSE '\' END AS path FROM pages),
q AS (SELECT page_id, regexp_extract(regexp_replace(path, '[/\\]+$', ''), '([^/\\]*)$', 1) AS dir, regexp_extract(path, '([^/\\]*)$', 1) AS file FROM p)
SELECT page_id, regexp_replace(dir, '\.[^.]*$', '') || '.zar' AS archive, regexp_replace(file, '\.[^.]*$', '') || '_extracted' AS extracted FROM q""")
def default_names(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.lit("games/v"), k % 9, F.lit("."), k, picked(["/", ".zar", "", "\\"], k))
    return read(spark, sf_dir, "pages").select(
        "page_id", paths.default_archive_name(path, ".zar").alias("archive"), paths.default_extract_name(path).alias("extracted")
    )


@query("""WITH e AS (SELECT event_id, event_id % 1000 AS done, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1000 + event_id % 7 END AS total,
  event_id % 20 AS f, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 40 END AS n FROM events)
SELECT event_id, CASE WHEN total > 0 THEN done / total WHEN n > 0 THEN f / n ELSE 1.0 END::DOUBLE AS ratio FROM e""")
def progress_ratios(spark, sf_dir):
    e = F.col("event_id")
    total, n = F.when(e % 3 == 0, 0).otherwise(1000 + e % 7), F.when(e % 2 == 0, 0).otherwise(40)
    ratio = parsing.progress_ratio(e % 1000, total, e % 20, n)
    return read(spark, sf_dir, "events").select("event_id", ratio.cast("double").alias("ratio"))


WEIGHTS = """(VALUES ('archive', '7z', 0.0, 0.33), ('archive', 'xiso', 0.33, 0.33), ('archive', 'zar', 0.66, 0.34), ('iso', 'xiso', 0.0, 0.5),
  ('iso', 'zar', 0.5, 0.5), ('directory', 'zar', 0.0, 1.0)) w(kind, stage, base, len)"""


@query(f"""WITH e AS (SELECT event_id, (['archive', 'iso', 'directory', 'all'])[(event_id % 4 + 1)::INT] AS kind, (['7z', 'xiso', 'zar', 'all', 'other'])[(event_id // 4 % 5 + 1)::INT] AS stage,
  (event_id % 101) / 100.0 AS local FROM events)
SELECT event_id, kind, stage, coalesce(base + len * local, local)::DOUBLE AS share FROM e LEFT JOIN {WEIGHTS} USING (kind, stage)""")
def stage_weights(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        "event_id",
        picked(["archive", "iso", "directory", "all"], e).alias("kind"),
        picked(["7z", "xiso", "zar", "all", "other"], F.floor(e / 4)).alias("stage"),
    )
    local = (F.col("event_id") % 101) / F.lit(100.0)
    return rows.withColumn("share", parsing.rebase(F.col("kind"), F.col("stage"), local).cast("double"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0.66 + 0.34 * ((event_id % 101) / 100.0) WHEN 'view' THEN 0.33 + 0.33 * ((event_id % 101) / 100.0)
ELSE (event_id % 101) / 100.0 END::DOUBLE AS share FROM events""")
def stage_rebase(spark, sf_dir):
    stage = F.when(F.col("event_type") == "click", "zar").when(F.col("event_type") == "view", "xiso").otherwise("other")
    local = (F.col("event_id") % 101) / F.lit(100.0)
    return read(spark, sf_dir, "events").select(
        "event_id", parsing.rebase(F.lit("archive"), stage, local).cast("double").alias("share")
    )


@query(f"""SELECT doc_id, CASE WHEN {SZ} * 40 <= 16384 THEN 'Le16K' WHEN {SZ} * 40 <= 131072 THEN 'Le128K' WHEN {SZ} * 40 <= 262144 THEN 'Le256K' ELSE 'Default' END AS tier FROM documents""")
def size_tiers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", parsing.size_tier(n_bytes() * 40).alias("tier"))


@query(f"""SELECT doc_id, ({SZ} + ({SZ} >> 8) + CASE WHEN {SZ} < 131072 THEN (131072 - {SZ}) >> 11 ELSE 0 END)::BIGINT AS bound, (({SZ} >> 6) + 2)::BIGINT AS gain FROM documents""")
def compress_bound(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", parsing.compress_bound(n_bytes()).alias("bound"), parsing.min_gain(n_bytes(), 6).alias("gain")
    )


#: Names given one after the other: the wanted one, or the first with a number that none has.
CLAIM = """WITH RECURSIVE w AS (SELECT page_id, {stem} AS stem, {ext} AS ext, row_number() OVER (ORDER BY page_id) AS i FROM pages),
r AS (SELECT 0::BIGINT AS i, {taken}::VARCHAR[] AS has, ''::VARCHAR AS choice UNION ALL
  SELECT i, list_append(has, {fold}), choice FROM (
    SELECT w.i, has, list_filter(list_transform(range(0, len(has) + 2), lambda n: CASE WHEN n = 0 THEN stem || ext ELSE stem || '_' || n || ext END),
      lambda choice: NOT list_contains(has, {fold}))[1] AS choice FROM r JOIN w ON w.i = r.i + 1))
SELECT page_id, choice AS {out} FROM r JOIN w USING (i)"""
STEMS = "CASE WHEN page_id % 9 = 4 THEN 'p' || page_id % 7 || '_' || page_id % 5 WHEN page_id % 11 = 3 THEN 'p_1_1' ELSE 'p' || page_id % 7 END"


def stems(p: Column) -> Column:
    odd = F.concat(F.lit("p"), p % 7, F.lit("_"), p % 5)
    return F.when(p % 9 == 4, odd).when(p % 11 == 3, "p_1_1").otherwise(F.concat(F.lit("p"), p % 7))


@query(CLAIM.format(stem=STEMS, ext="'.html'", taken="['p3.html', 'p3_2.html', 'p6_1.html']", fold="choice", out="free"))
def auto_rename(spark, sf_dir):
    """Wanted names clash with generated ones and with files that are there."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    path = F.concat(stems(F.col("page_id")), F.lit(".html"))
    there = spark.createDataFrame([(x,) for x in ("p3.html", "p3_2.html", "p6_1.html")], "path string")
    return batch.free_names(pages, path, "page_id", there)


@query(CLAIM.format(stem="CASE WHEN page_id % 2 = 0 THEN upper(" + STEMS + ") ELSE " + STEMS + " END", ext="''", taken="[]", fold="lower(choice)", out="destination"))
def claimed_destinations(spark, sf_dir):
    """Wanted names clash with generated ones, in upper and lower case."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    wanted = stems(F.col("page_id"))
    return batch.claimed(pages, F.when(F.col("page_id") % 2 == 0, F.upper(wanted)).otherwise(wanted), "page_id")


STATUS_SQL = "CASE event_type WHEN 'click' THEN 'Completed' WHEN 'view' THEN 'Completed' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Skipped' END ELSE 'Completed' END"


def outcomes(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 3 == 0, "Failed").otherwise("Skipped")
    status = F.when(F.col("event_type") == "purchase", odd).otherwise("Completed")
    return events.select("event_id", "user_id", status.alias("status"))


@query(f"""WITH o AS (SELECT user_id, {STATUS_SQL} AS status FROM events) SELECT user_id, count(*) FILTER (status = 'Completed')::BIGINT AS succeeded,
count(*) FILTER (status = 'Failed')::BIGINT AS failed, count(*) FILTER (status = 'Skipped')::BIGINT AS skipped FROM o GROUP BY user_id""")
def outcome_counts(spark, sf_dir):
    return batch.outcome_counts(outcomes(spark, sf_dir), ("user_id",))


@query(f"""WITH o AS (SELECT user_id, CASE WHEN event_id % 31 = 0 THEN 'Cancelled' ELSE {STATUS_SQL} END AS status FROM events) SELECT user_id, CASE WHEN count(*) FILTER (status <> 'Completed') = 0 THEN 'Completed'
WHEN count(*) FILTER (status = 'Cancelled') > 0 THEN 'Cancelled' WHEN count(*) FILTER (status = 'Failed') > 0 THEN 'Failed' ELSE 'Partial' END AS state FROM o GROUP BY user_id""")
def batch_rollup(spark, sf_dir):
    stopped = F.when(F.col("event_id") % 31 == 0, "Cancelled").otherwise(F.col("status"))
    return batch.roll_up(outcomes(spark, sf_dir).withColumn("status", stopped), ("user_id",))


ERRORS = "CASE WHEN event_id % 2 = 0 THEN 'Output exists: ' || event_id ELSE 'disk full' END"


@query(f"""WITH o AS (SELECT user_id % 50 + 100 * (user_id % 2) AS batch, {STATUS_SQL} AS status, {ERRORS} AS error FROM events WHERE event_id % 2 = 0 OR user_id % 4 < 2),
c AS (SELECT batch, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Failed' AND starts_with(error, 'Output exists')) AS refused FROM o GROUP BY batch)
SELECT batch, refused::BIGINT AS refused, CASE WHEN failed = 0 THEN 0 WHEN failed = refused THEN -11 ELSE -13 END AS exit_code FROM c""")
def refusal_exit_codes(spark, sf_dir):
    """Some batches have refusals only, some other failures too."""
    e, u = F.col("event_id"), F.col("user_id")
    error = F.when(e % 2 == 0, F.concat(F.lit("Output exists: "), e)).otherwise("disk full")
    items = outcomes(spark, sf_dir).where((e % 2 == 0) | (u % 4 < 2)).withColumns({"error": error, "batch": u % 50 + 100 * (u % 2)})
    refused = batch.refusals(items, "Output exists", ("batch",))
    return refused.join(batch.exit_codes(items, "Output exists", ("batch",)), "batch")


OUTCOMES = list(parsing.EXIT_CODES)


@query("SELECT event_id, ([0, -1, -3, -4, -10, -11, -12, -13, -14, -15, -16, NULL])[(event_id % 12 + 1)::INT] AS code FROM events")
def exit_codes(spark, sf_dir):
    outcome = picked([*OUTCOMES, "unknown"], F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", parsing.exit_code(outcome).alias("code"))


@query(f"""WITH o AS (SELECT event_id, {STATUS_SQL} AS status FROM events)
SELECT event_id, status, CASE WHEN event_id % 3 = 0 THEN event_id END AS bytes FROM o""")
def concatenated_results(spark, sf_dir):
    """Result lists of three batches, of which only one tells bytes."""
    o = outcomes(spark, sf_dir).select("event_id", "status")
    e = F.col("event_id")
    return batch.concatenated(o.where(e % 3 == 0).withColumn("bytes", e), o.where(e % 3 == 1), o.where(e % 3 == 2))


@query("""SELECT event_id, least((count(*) OVER w - 1 + (event_id % 11) / 10.0) / 1000.0, 1.0)::DOUBLE AS batch_ratio FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def batch_progress(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.lit(True).alias("ended"))
    local = F.least((F.col("event_id") % 11) / F.lit(10.0), F.lit(1.0))
    return batch.batch_progress(events, "user_id", "event_id", F.lit(1000.0), local).select("event_id", "batch_ratio")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_outputs(spark, sf_dir):
    return batch.missing(docs(spark, sf_dir).select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def present_outputs(spark, sf_dir):
    return batch.present(docs(spark, sf_dir).select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 1)")
def tree_difference(spark, sf_dir):
    ids = docs(spark, sf_dir).select("doc_id")
    return tree.difference(ids.where("doc_id % 10 <> 1"), ids.where("doc_id % 10 <> 0"))


@query("""WITH h AS (SELECT o_orderkey, o_custkey, lpad(hex(o_orderkey), 8, '0') AS x FROM orders)
SELECT o_orderkey, x AS be, substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS le, o_orderkey AS be_back, o_orderkey AS le_back,
(o_orderkey % 65536 * 4294967296 + o_custkey)::BIGINT AS wide, o_orderkey <= 100000 AND o_custkey <= 100000 - o_orderkey AS inside FROM h""")
def integers(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    total = F.lit(100_000).cast("bigint")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.hex(be_bytes(k, 4)).alias("be"),
        F.hex(le_bytes(k, 4)).alias("le"),
        be_uint(be_bytes(k, 4), 0, 4).alias("be_back"),
        le_uint(le_bytes(k, 4), 0, 4).alias("le_back"),
        low_high(c, k % 65536).alias("wide"),
        within(k, c, total).alias("inside"),
    )


@query("SELECT doc_id, sha256(text) AS back, true AS latin FROM documents")
def latin_text(spark, sf_dir):
    raw = latin.to_1252(F.col("text"))
    return docs(spark, sf_dir).select(
        "doc_id", "text", raw.alias("raw")
    ).select("doc_id", F.sha2(latin.from_1252(F.col("raw")), 256).alias("back"), (F.octet_length("raw") == F.char_length("text")).alias("latin"))


@query(f"SELECT doc_id, {SZ}::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def zstd_roundtrip(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    packed = rows.select("doc_id", F.octet_length("raw").alias("n"), codec.compress(F.col("raw"), level=6).alias("z"))
    plain = packed.select("doc_id", codec.decompress_exact(F.col("z"), F.col("n")).alias("raw"))
    return plain.select("doc_id", F.octet_length("raw").cast("bigint").alias("size"), F.sha2("raw", 256).alias("sha256"))


@query()
def zstd_ratio(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = rows.select("doc_id", F.octet_length("raw").alias("n"), *[
        F.octet_length(codec.compress(F.col("raw"), level=n)).alias(f"level_{n}") for n in (1, 6)
    ])
    return packed.agg(F.sum("n").alias("raw"), F.sum("level_1").alias("level_1"), F.sum("level_6").alias("level_6"))


@query()
def xxh64_digest(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return docs(spark, sf_dir).select("doc_id", codec.xxh64(raw).alias("xxh64"), codec.xxh64(raw, 42).alias("seed_42"))


@query("""WITH s AS (SELECT string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY doc_id) AS x FROM documents),
b AS (SELECT x, unnest(range(0, (length(x) + 131071) // 131072)) AS b FROM s)
SELECT b::BIGINT AS block_id, sha256(rpad(substr(x, b * 131072 + 1, 131072), 131072, '0')) AS sha256 FROM b""")
def compressed_blocks(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    made = archives.blocks(rows, "doc_id", "content")
    plain = F.when(F.col("stored") < layout.BLOCK_SIZE, codec.decompress(F.col("payload"))).otherwise(F.col("payload"))
    return made.select("block_id", F.sha2(F.hex(plain), 256).alias("sha256"))


@query(f"""SELECT doc_id AS key, sha256(coalesce(text, '')) AS all_sha256,
CASE WHEN {SZ} >= 1500 THEN sha256(substr(hex(encode(text)), 2001, 1000)) END AS range_sha256 FROM documents""")
def seekable_files(spark, sf_dir):
    """Every document as a seekable file, short and empty ones too; the range only of those that have it."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("key"), raw.alias("raw"))
    files = seekable.assemble(seekable.fixed_frames(rows, "key", F.col("raw"), 700), "key")
    long = rows.where(F.octet_length("raw") >= 1500).select("key")
    part = seekable.read_range(files.join(long, "key", "left_semi"), "key", 1000, 500)
    whole = seekable.read_all(files, "key")
    return whole.select("key", F.sha2("content", 256).alias("all_sha256")).join(
        part.select("key", F.sha2(F.hex("content"), 256).alias("range_sha256")), "key", "left"
    )


def scratch(spark: SparkSession) -> str:
    """A folder that all of a cluster sees: below the shared checkpoint folder. Only where that is unset
    and the executors are threads of the driver, as in tests, it is a local one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="cairn-")
    folder = f"{base}/archives-{uuid.uuid4().hex}"
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    return path if folder.startswith(("file:", "/")) else folder


@query("SELECT page_id || '.html' AS name, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS size FROM pages")
def archive_roundtrip(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    name = F.concat(F.col("page_id"), F.lit(".html"))
    path = F.concat(F.lit("site/"), F.col("page_id") % 7, F.lit("/"), name)
    target = f"{scratch(spark)}/pages.zar"
    archives.pack(pages.select(path.alias("path"), F.col("html").cast("binary").alias("content")), target)
    files = archives.entries(spark, target, content=True).where("is_file")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "size"
    )


@query("SELECT 'site/' || page_id % 7 AS path, count(*)::BIGINT AS n_files, sum(octet_length(encode(html)))::BIGINT AS n_bytes FROM pages GROUP BY 1")
def archive_listing(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    path = F.concat(F.lit("site/"), F.col("page_id") % 7, F.lit("/"), F.col("page_id"))
    target = f"{scratch(spark)}/pages.zar"
    archives.pack(pages.select(path.alias("path"), F.col("html").cast("binary").alias("content")), target)
    got = archives.entries(spark, target)
    files = tree.directory_rollup(got.where("is_file"), F.col("path"), F.col("size"))
    return files.join(got.where("NOT is_file").select(F.col("path").alias("directory")), "directory").where(
        "directory <> 'site'"
    ).select(F.col("directory").alias("path"), "n_files", "n_bytes")


LL = "[" + ", ".join(map(str, matching.least_lengths(matching.LITERAL_BITS))) + "]"
ML = "[" + ", ".join(map(str, matching.least_lengths(matching.MATCH_BITS))) + "]"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN n > 63 THEN 19 + floor(log2(n))::INT ELSE len(list_filter({LL}, lambda x: x <= n)) - 1 END::INT AS literal,
CASE WHEN m > 127 THEN 36 + floor(log2(m))::INT ELSE len(list_filter({ML}, lambda x: x <= m)) - 1 END::INT AS match, floor(log2(o))::INT AS off
FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_linenumber % 70000 AS n, l_suppkey * l_linenumber % 300 AS m, l_partkey + 3 AS o FROM lineitem)""")
def length_codes(spark, sf_dir):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        matching.literal_code(p * n % 70000).alias("literal"),
        matching.match_code(s * n % 300).alias("match"),
        matching.offset_code(p + 3).alias("off"),
    )


@query("""WITH s AS (SELECT o_orderkey, 2 + o_orderkey * 31 % 5000 AS n, o_custkey % 256 AS m FROM orders),
l AS (SELECT *, floor(log2(n - 1))::INT - 2 AS a, least(floor(log2(n))::INT + 1, CASE WHEN m > 0 THEN floor(log2(m))::INT ELSE 0 END + 2) AS b FROM s)
SELECT o_orderkey, least(greatest(CASE WHEN a >= 0 AND a < 11 THEN a ELSE 11 END, b, 5), 12)::INT AS log FROM l""")
def table_logs(spark, sf_dir):
    size, most = 2 + F.col("o_orderkey") * 31 % 5000, F.col("o_custkey") % 256
    return read(spark, sf_dir, "orders").select("o_orderkey", matching.table_log(size, most).alias("log"))


@query("""WITH q AS (SELECT *, o - 1 + z AS a FROM (SELECT o_orderkey, [1 + o_orderkey % 9, 4, 8 + o_custkey % 5]::BIGINT[] AS h, 1 + o_orderkey % 7 AS o, (o_custkey % 2)::INT AS z FROM orders)),
u AS (SELECT *, CASE WHEN o > 3 THEN o - 3 WHEN a = 3 THEN h[1] - 1 ELSE h[a + 1] END AS used FROM q)
SELECT o_orderkey, used::BIGINT AS used, array_to_string(CASE WHEN o <= 3 AND a = 0 THEN h ELSE [used, h[1], CASE WHEN o <= 3 AND a < 2 THEN h[3] ELSE h[2] END] END, ',') AS history FROM u""")
def offset_histories(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    history = F.array((1 + k % 9).cast("bigint"), F.lit(4).cast("bigint"), (8 + c % 5).cast("bigint"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", history.alias("h"), (1 + k % 7).alias("o"), (c % 2).alias("z"))
    after = matching.next_history(F.col("h"), F.col("o"), F.col("z"))
    return rows.select(
        "o_orderkey", matching.raw_offset(F.col("h"), F.col("o"), F.col("z")).alias("used"), F.array_join(after, ",").alias("history")
    )


def hash_sql(k: int) -> str:
    """A column of the hash of ``k`` bytes of x, as many bits as 17."""
    bytes_ = " + ".join(f"('0x' || substr(x, {2 * i + 1}, 2))::UHUGEINT * {1 << 8 * (i + (0 if k == 4 else 8 - k))}" for i in range(k))
    size = 32 if k == 4 else 64
    return f"((({bytes_}) * {matching.PRIMES[k]}::UHUGEINT % {1 << size}::UHUGEINT) // {1 << (size - 17)}::UHUGEINT)::BIGINT AS hash_{k}"


@query(f"WITH d AS (SELECT doc_id, rpad(hex(encode(coalesce(text, ''))), 16, '0') AS x FROM documents) SELECT doc_id, {', '.join(map(hash_sql, matching.PRIMES))} FROM d")
def byte_hashes(spark, sf_dir):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    hashes = [matching.hash_bytes(raw, F.lit(0), 17, k).alias(f"hash_{k}") for k in matching.PRIMES]
    return docs(spark, sf_dir).select("doc_id", *hashes)


@query(r"""WITH t AS (SELECT doc_id, 'at C:\Users\Ann\x, c:/users/ann/y by ann, Anna; ANN' || doc_id || ' ann.' || substr(text, 1, 40) AS t FROM documents),
p AS (SELECT doc_id, replace(replace(t, 'C:\Users\Ann', chr(1)), 'c:/users/ann', chr(1)) AS t FROM t)
SELECT doc_id, replace(regexp_replace(t, '(^|[^\pL\p{Nd}])(?i:ann)($|[^\pL\p{Nd}])', '\1[user]\2', 'g'), chr(1), '%USERPROFILE%') AS clean FROM p""")
def sanitized_reports(spark, sf_dir):
    report = F.concat(
        F.lit("at C:\\Users\\Ann\\x, c:/users/ann/y by ann, Anna; ANN"), "doc_id", F.lit(" ann."), F.substring("text", 1, 40)
    )
    return docs(spark, sf_dir).select("doc_id", reports.sanitized(report, "ann", "C:\\Users\\Ann").alias("clean"))


@query("""SELECT doc_id, replace(to_json('"' || chr(9) || chr(1) || '\\' || substr(text, 1, 300) || chr(31))::VARCHAR, '\\u001F', '\\u001f') AS json FROM documents""")
def json_strings(spark, sf_dir):
    text = F.concat(F.lit('"\t\x01\\'), F.substring("text", 1, 300), F.lit("\x1f"))
    return docs(spark, sf_dir).select("doc_id", reports.json_string(text).alias("json"))


DICTIONARY = b"the quick brown fox jumps over the lazy dog and the end of the line. " * 40


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS plain, sha256(coalesce(text, '')) AS with_dictionary, sha256(coalesce(text, '') || coalesce(text, '')) AS twice,
CASE WHEN octet_length(encode(coalesce(text, ''))) <= 1000 THEN sha256(coalesce(text, '')) END AS bounded FROM documents""")
def codec_forms(spark, sf_dir):
    """A stream's frame, a frame with a dictionary, several frames with a skippable one, and a bound."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    skip = F.unhex(F.lit("502A4D1803000000616263"))
    made = docs(spark, sf_dir).select(
        "doc_id",
        codec.compress(raw, "zstd-stream", level=3).alias("s"),
        codec.compress(raw, "zstd", level=6, dict_data=DICTIONARY).alias("d"),
        codec.compress(raw, "zstd", level=1, checksum=True).alias("z"),
    )
    sha = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id",
        sha(codec.decompress(F.col("s"))).alias("plain"),
        sha(codec.decompress(F.col("d"), dict_data=DICTIONARY)).alias("with_dictionary"),
        sha(codec.decompress(F.concat("s", skip, "z"))).alias("twice"),
        sha(codec.decompress(F.col("s"), most=1000, fail=False)).alias("bounded"),
    )


def page_path() -> Column:
    return F.concat(F.lit("site/"), F.col("page_id") % 7, F.lit("/"), F.col("page_id"), F.lit(".html"))


def packed_pages(spark, sf_dir) -> str:
    """An archive of all pages, in seven folders."""
    target = f"{scratch(spark)}/pages.zar"
    archives.pack(read(spark, sf_dir, "pages").select(page_path().alias("path"), F.col("html").cast("binary").alias("content")), target)
    return target


PAGE = "'site/' || page_id % 7 || '/' || page_id || '.html'"


@query(f"""WITH p AS (SELECT {PAGE} AS path, page_id, hex(encode(html)) AS x FROM pages)
SELECT path, "start", sha256(substr(x, 2 * "start" + 1, 600)) AS sha256 FROM p, (VALUES (0::BIGINT), (50), (700), (100000)) s("start")""")
def archive_ranges(spark, sf_dir):
    """300 bytes of each file of an archive from four places on, the last past the end of most."""
    target = packed_pages(spark, sf_dir)
    files_ = archives.entries(spark, target).where("is_file").select("path")
    starts = F.array(*[F.lit(x).cast("bigint") for x in (0, 50, 700, 100_000)])
    asked = files_.select(F.upper("path").alias("asked"), "path", F.explode(starts).alias("start")).withColumn("length", F.lit(300))
    got = archives.read_ranges(asked, target, "asked")
    return got.select("path", "start", F.sha2(F.hex("content"), 256).alias("sha256"))


@query("""SELECT (page_id % 7)::VARCHAR AS folder, page_id || '.html' AS name, sha256(html) AS sha256,
(row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id || '.html') - 1)::INT AS place FROM pages""")
def extracted_batches(spark, sf_dir):
    """An archive is extracted, each of its folders is packed again by a batch, extracted and read."""
    target = packed_pages(spark, sf_dir)
    top = os.path.dirname(target)
    archives.extract(target, f"{top}/out")
    rows = [(f"{top}/out/site/{i}", f"{top}/again/{i}.zar") for i in range(7)]
    os.makedirs(f"{top}/again")
    items = spark.createDataFrame([r for r in rows if os.path.isdir(r[0])], "source string, destination string").repartition(4)
    done = archives.batch(items, "pack").where("status = 'Completed'").collect()
    back = spark.createDataFrame([(r.destination, f"{top}/back/{os.path.basename(r.source)}") for r in done], "source string, destination string")
    done = archives.batch(back.repartition(4), "extract", delete_source=True).where("status = 'Completed'").collect()
    parts = []
    for r in done:
        listed = archives.source(spark, r.destination).select("path", "content")
        names = spark.createDataFrame([(p, i) for i, (p, _) in enumerate(archives.walk(r.destination))], "path string, place int")
        parts.append(listed.join(names, "path").withColumn("folder", F.lit(os.path.basename(r.destination))))
    return batch.concatenated(*parts).select("folder", F.col("path").alias("name"), F.sha2("content", 256).alias("sha256"), "place")


FAILURES = ["None", "TooSmall", "BadMagic", "UnsupportedVersion", "LengthMismatch", "SectionOutOfRange", "BadOffsetRecords", "BadFileTree", "BadFileTree", "TooSmall"]


#: Bytes of pages, about, in each BINARY archive: a value must fit in a row, so all pages take several.
VALUE_BYTES = 1 << 20


def page_archives(spark, sf_dir) -> DataFrame:
    """All pages in archives that are BINARY values, ``(part, data)``; each has a file of its number too, so
    that there is one of an empty table."""
    pages = read(spark, sf_dir, "pages")
    total = pages.agg(F.sum(F.octet_length("html").cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // VALUE_BYTES))
    part = F.pmod(F.xxhash64("page_id"), F.lit(n)).alias("part")
    rows = pages.select(part, page_path().alias("path"), F.col("html").cast("binary").alias("content"))
    numbers = spark.range(n).select(F.col("id").alias("part"), F.lit("part.txt").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    return archives.packed_values(rows.unionByName(numbers), "part")


def damaged(good: bytes) -> list[bytes | None]:
    """An archive as it is, then damaged in the ways of ``FAILURES``."""
    foot = len(good) - 144

    def put(place: int, data: bytes) -> bytes:
        return good[:place] + data + good[place + len(data) :]

    records = int.from_bytes(good[foot + 24 : foot + 32], "big")
    tree_at = int.from_bytes(good[foot + 48 : foot + 56], "big")
    return [
        good,
        good[:144],
        put(len(good) - 4, b"\0"),
        put(len(good) - 8, b"\0"),
        b"x" + good,
        put(foot, b"\x7f"),
        put(foot + 24, (records - 1).to_bytes(8, "big")),
        put(foot + 56, bytes(8)),
        put(tree_at, b"\xff"),
        None,
    ]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FAILURES)) + ") t(id, failure)")
def open_failures(spark, sf_dir):
    """Archives as BINARY values, damaged in several ways by the tasks that hold them; where archives of
    one kind of damage fail differently, all their failures are named."""

    def damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for good in b.column("data"):
                for i, value in enumerate(damaged(good.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([str(i)]), pa.array([value], pa.binary())], ["id", "data"])

    rows = page_archives(spark, sf_dir).select("data").mapInArrow(damage, "id string, data binary")
    got = archives.entries_in(rows, "id", "data").groupBy(F.col("archive").cast("int").alias("id"))
    return got.agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("failure", F.lit("None")))), ",").alias("failure"))


@query("""SELECT (page_id % 7)::VARCHAR || '/' || page_id || '.html' AS name, greatest(1, (octet_length(encode(html)) + 999) // 1000)::BIGINT AS n_frames,
octet_length(encode(html))::BIGINT AS total_decomp, least(octet_length(encode(html)), 1000)::BIGINT AS max_decomp, sha256(html) AS sha256 FROM pages""")
def file_verbs(spark, sf_dir):
    """Files compressed as seekable ones, listed by their tails and decompressed again."""
    target = packed_pages(spark, sf_dir)
    top = os.path.dirname(target)
    archives.extract(target, f"{top}/out")
    names = [p for p, f in archives.walk(f"{top}/out/site") if f is not None]
    for i in range(7):
        os.makedirs(f"{top}/z/{i}"), os.makedirs(f"{top}/back/{i}")
    kind = "source string, destination string"
    items = spark.createDataFrame([(f"{top}/out/site/{n}", f"{top}/z/{n}.zst") for n in names], kind).repartition(8)
    made = files.compress_files(items, frame_size=1000).where("status = 'Completed'").select("destination").collect()
    made = spark.createDataFrame(made, "path string").repartition(8)
    listed = files.list_files(made)
    back = made.select(F.col("path").alias("source"), F.regexp_replace(F.replace("path", F.lit(f"{top}/z/"), F.lit(f"{top}/back/")), r"\.zst$", "").alias("destination"))
    done = files.decompress_files(back).where("status = 'Completed'").count()
    if done != len(names):
        raise ValueError(f"{len(names) - done} files did not come back")
    plain = archives.source(spark, f"{top}/back").where("NOT is_dir")
    name = F.regexp_replace(F.replace("path", F.lit(f"{top}/z/"), F.lit("")), r"\.zst$", "")
    sizes = listed.select(name.alias("name"), "n_frames", "total_decomp", "max_decomp")
    return sizes.join(plain.select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256")), "name")


def streamed(spark, chunks: DataFrame, run) -> DataFrame:
    """What a streaming query makes of chunks that lie in a folder."""
    top = scratch(spark)
    chunks.coalesce(1).write.parquet(f"{top}/in")
    made = run(spark.readStream.schema(chunks.schema).parquet(f"{top}/in"))
    writer = made.writeStream.format("parquet").option("checkpointLocation", f"{top}/check")
    writer.trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{top}/out")


def turns(spark, sf_dir) -> DataFrame:
    """Conversations as chunks of a stream."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("key"),
        F.col("turn").cast("bigint").alias("seq"),
        F.col("text").cast("binary").alias("data"),
        (F.row_number().over(w) == 1).alias("last"),
    )


SAID = "c AS (SELECT conv_id::VARCHAR AS key, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id)"


@query(f"""WITH {SAID}, f AS (SELECT key, x, unnest(range(0, greatest(1, (length(x) // 2 + 63) // 64))) AS k FROM c)
SELECT key, k::BIGINT AS frame_id, (length(substr(x, k * 128 + 1, 128)) // 2)::BIGINT AS d_size, sha256(substr(x, k * 128 + 1, 128)) AS sha256 FROM f""")
def stream_frames(spark, sf_dir):
    got = streamed(spark, turns(spark, sf_dir), lambda s: streams.frame_stream(s, 64))
    return got.select("key", "frame_id", "d_size", F.sha2(F.hex(codec.decompress(F.col("payload"))), 256).alias("sha256"))


@query(f"WITH {SAID} SELECT key, 1::BIGINT AS n_frames, (length(x) // 2)::BIGINT AS size, sha256(x) AS sha256 FROM c")
def stream_measured(spark, sf_dir):
    """Frames by compressed size: none of these streams fills one."""
    got = streamed(spark, turns(spark, sf_dir), lambda s: streams.measured_stream(s, 1 << 20))
    plain = got.select("key", "frame_id", "d_size", F.hex(codec.decompress(F.col("payload"))).alias("x"))
    return plain.groupBy("key").agg(
        F.count("*").alias("n_frames"), F.sum("d_size").alias("size"), F.sha2(F.max("x"), 256).alias("sha256")
    )


@query(f"WITH {SAID} SELECT key, (length(x) // 2)::BIGINT AS size, sha256(x) AS sha256 FROM c WHERE x <> ''")
def stream_decode(spark, sf_dir):
    """Files of several frames, cut into chunks of 50 bytes and decoded as they come."""
    frames_ = turns(spark, sf_dir).select("key", "seq", codec.compress(F.coalesce("data", F.unhex(F.lit(""))), "zstd-stream").alias("z"))
    whole = frames_.groupBy("key").agg(seekable.joined_bytes("z", "seq").alias("z"))
    n = F.ceil(F.octet_length("z") / 50).cast("int")
    cut = whole.select("key", "z", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    chunks = cut.select(
        "key", F.col("i").cast("bigint").alias("seq"), F.substring("z", F.col("i") * 50 + 1, F.lit(50)).alias("data"), (F.col("i") == F.col("n") - 1).alias("last")
    )
    got = streamed(spark, chunks, streams.decode_stream)
    plain = got.groupBy("key").agg(seekable.joined_bytes("content", "`offset`").alias("content"), F.max("failure").alias("failure"))
    return plain.where("failure IS NULL").select(
        "key", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.hex("content"), 256).alias("sha256")
    )


@query(f"""WITH o AS (SELECT ts, {STATUS_SQL} AS status, event_id % 1000 AS bytes FROM events),
w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, * FROM o)
SELECT epoch(s)::BIGINT AS start, count(*)::BIGINT AS n, count(*) FILTER (status = 'Failed')::BIGINT AS failed, sum(bytes)::BIGINT AS bytes FROM w GROUP BY s""")
def stream_progress(spark, sf_dir):
    """Progress by the hour, over all events; the last hours are given as the stream ends."""
    done = outcomes(spark, sf_dir).select("event_id", "status").join(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    rows = done.select(F.col("ts").cast("timestamp").alias("ts"), "status", (F.col("event_id") % 1000).alias("bytes"))
    top = scratch(spark)
    rows.coalesce(1).write.parquet(f"{top}/in")
    made = streams.progress(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), "10 minutes", "1 hour")
    name = f"progress_{uuid.uuid4().hex}"
    made.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{top}/check").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.table(name).select(F.unix_timestamp("start").alias("start"), "n", "failed", "bytes")


@query("SELECT page_id || '.html' AS name, octet_length(encode(html))::BIGINT AS length, sha256(html) AS sha256 FROM pages")
def stream_arrivals(spark, sf_dir):
    """Files that arrive in a directory."""
    target = packed_pages(spark, sf_dir)
    top = os.path.dirname(target)
    archives.extract(target, f"{top}/out")
    made = streams.arriving_files(spark, f"{top}/out/site/*", ".html")
    made.writeStream.format("parquet").option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start(
        f"{top}/seen"
    ).awaitTermination()
    seen = spark.read.parquet(f"{top}/seen")
    return seen.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
