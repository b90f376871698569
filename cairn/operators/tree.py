"""Directory trees and name tables as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import components, fold, prefixes
from cairn.operators.layout import running_total

#: Fixed values of the tree format.
MAX_DEPTH = 1024
MAX_TOTAL = (1 << 64) - 1


def directory_rollup(files: DataFrame, path: Column, size: Column) -> DataFrame:
    """Files and bytes below each directory, at any depth; the root is the empty path."""
    steps = prefixes(path)
    above = F.concat(F.array(F.lit("")), F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))))
    rows = files.select(above.alias("__above"), size.cast("bigint").alias("__size"))
    return (
        rows.select(F.explode("__above").alias("directory"), "__size")
        .groupBy("directory")
        .agg(F.count("*").alias("n_files"), F.sum(F.greatest("__size", F.lit(0))).alias("n_bytes"))
    )


def nodes(files: DataFrame, path: Column, size: Column, is_dir: Column | None = None) -> DataFrame:
    """``(path, parent, name, depth, is_file, size)``: each path once, directories on the way included.

    Names are told apart by their A-Z folded form, so paths are kept folded beside their spelling; of
    several spellings of a directory the least stands. A path that is both file and directory raises
    when packed; here the file row is dropped.
    """
    steps = prefixes(path)
    dir_ = F.lit(False) if is_dir is None else is_dir
    rows = files.select(steps.alias("steps"), size.cast("bigint").alias("size"), dir_.alias("is_dir"))
    each = rows.where(F.size("steps") > 0).select(
        F.size("steps").alias("n"), "size", "is_dir", F.posexplode("steps").alias("k", "path")
    )
    one = each.select(
        "path",
        (F.col("k") + 1).alias("depth"),
        (~F.col("is_dir") & (F.col("k") + 1 == F.col("n"))).alias("is_file"),
        F.when(F.col("k") + 1 == F.col("n"), F.col("size")).alias("size"),
    )
    folded = fold(F.col("path"))
    got = one.groupBy(folded.alias("folded"), "depth").agg(
        F.min("path").alias("path"),
        F.bool_and("is_file").alias("is_file"),
        F.max(F.when(F.col("is_file"), F.col("size"))).alias("size"),
    )
    name = F.element_at(components(F.col("path")), -1)
    parent = F.regexp_replace("folded", "/?[^/]*$", "")
    return got.select(
        "path", "folded", parent.alias("parent"), name.alias("name"), "depth", "is_file",
        F.when(F.col("is_file"), F.coalesce("size", F.lit(0))).otherwise(0).alias("size"),
    )


def breadth_first(tree: DataFrame, most_depth: int = MAX_DEPTH) -> DataFrame:
    """``node_id``, ``child_start`` and ``child_count`` of each node; the root, id 0, is added.

    A level is ordered by its parents' ids, then by folded name. That is the order of whole paths,
    component by component, within a depth, so one running count over (depth, path) numbers all; a
    parent's children are contiguous. ``\\x01`` stands between components, below any character of a
    name.
    """
    spark = tree.sparkSession
    root = spark.range(1).select(
        F.lit("").alias("path"), F.lit("").alias("folded"), F.lit(None).cast("string").alias("parent"),
        F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(False).alias("is_file"), F.lit(0).cast("bigint").alias("size"),
    )
    too_deep = F.raise_error(F.lit(f"tree is deeper than {most_depth}")).cast("string")
    order = F.concat(F.lpad(F.col("depth").cast("string"), 4, "0"), F.replace("folded", F.lit("/"), F.lit("\x01")))
    rows = tree.select(root.columns).unionByName(root)
    rows = rows.withColumn("order", F.when(F.col("depth") > most_depth, too_deep).otherwise(order))
    numbered = running_total(rows, "order", F.lit(1), "node_id").drop("order")
    kids = numbered.where("depth > 0").groupBy(F.col("parent").alias("folded")).agg(
        F.min("node_id").alias("child_start"), F.count("*").alias("child_count")
    )
    out = numbered.join(kids, "folded", "left")
    return out.withColumn("child_count", F.when(~F.col("is_file"), F.coalesce("child_count", F.lit(0))))


def children(numbered: DataFrame, node_id: Column) -> DataFrame:
    """The entries of a directory by the range its node names."""
    one = numbered.where(F.col("node_id") == node_id).select("child_start", "child_count")
    hit = (F.col("c.node_id") >= F.col("p.child_start")) & (
        F.col("c.node_id") < F.col("p.child_start") + F.col("p.child_count")
    )
    return numbered.alias("c").join(F.broadcast(one.alias("p")), hit).select("c.*")  # p is one row


def lookup(paths: DataFrame, numbered: DataFrame, path: str = "path") -> DataFrame:
    """``node_id`` of each path, null if there is none: names match by A-Z folded equality."""
    wanted = fold(F.array_join(components(F.col(path)), "/"))
    ids = numbered.select(F.col("folded").alias("__folded"), "node_id")
    return paths.withColumn("__folded", wanted).join(ids, "__folded", "left").drop("__folded")


def name_table(names: DataFrame, name: Column, order: str) -> DataFrame:
    """``(name, first, offset)``: each distinct name once, in order of first appearance.

    A name's entry is its length, in one byte below 128 and else in two, and its bytes.
    """
    raw = names.select(name.alias("name"), F.col(order).alias("first"))
    once = raw.groupBy("name").agg(F.min("first").alias("first"))
    n = F.octet_length("name")
    entry = n + F.when(n >= 128, 2).otherwise(1)
    return running_total(once, "first", entry, "offset", ties=("name",))


def names_of(nodes: DataFrame, table: DataFrame, name_id: str = "name_id") -> DataFrame:
    """``nodes`` with ``raw``, the bytes of the name at a place of the name table, null if none begins there."""
    found = table.select(F.col("offset").alias(name_id), F.col("name").cast("binary").alias("raw"))
    return nodes.join(found, name_id, "left")


def totals(tree: DataFrame) -> DataFrame:
    """Entries, files and bytes of a tree; the sum stops at 64 bits."""
    total = F.coalesce(F.sum(F.greatest("size", F.lit(0)).cast("decimal(38,0)")), F.lit(0))
    return tree.agg(
        F.count("*").alias("n_entries"),
        F.count_if("is_file").alias("n_files"),
        F.least(total, F.lit(str(MAX_TOTAL)).cast("decimal(38,0)")).alias("n_bytes"),
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either tree that the other lacks, repeats counted, with the side they are on."""
    return (
        a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )
