"""Where files, blocks and offset records lie in one logical stream of bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the block format.
BLOCK_SIZE = 65536
SLOTS = 16


#: Sampled keys for each range that rows are cut into.
SAMPLED = 20


def bounds(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` keys that cut the rows into ranges of about equal numbers of rows.

    They come from a bounded random sample of the rows, whole keys whatever their type; they decide
    how work is spread, never a result.
    """
    if n < 2:
        return []
    drawn = df.select(F.col(key).alias("k"), F.rand(7).alias("r")).where("k IS NOT NULL").orderBy("r").limit(SAMPLED * n)
    keys = [row[0] for row in drawn.select("k").sort("k").collect()]
    step = max(1, len(keys) // n)
    return list(dict.fromkeys(keys[step::step]))[: n - 1]


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """How many cuts are below the key: first whole runs of them are counted, then those of one run."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    parts = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    ends = [x[-1] for x in parts if len(x) == size]
    wide = lambda values: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    run = below(wide(ends)) if ends else F.lit(0)
    within = below(F.get(F.array(*map(wide, parts)), run))
    return run * size + F.greatest(F.coalesce(within, F.lit(0)), F.lit(0))


def running_totals(
    df: DataFrame, key: str, values: dict[str, Column], within: tuple[str, ...] = (), ties: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of that value over the rows before each one,
    by ``key`` then ``ties``.

    Two levels, so that no task sees all rows: rows are cut into ranges of the key, ranges are
    summed and their sums added up (one row for each range and group), and each range adds up its
    own rows. All values go through it at once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType.simpleString()
    range_ = range_of(F.col(key), bounds(df, key, n), kind)
    names = list(values)
    rows = df.withColumns({"__range": range_} | {f"__v_{x}": values[x].cast("bigint") for x in names})
    sums = rows.groupBy(*within, "__range").agg(*[F.sum(f"__v_{x}").alias(f"__s_{x}") for x in names])
    before = W.partitionBy(*within).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(
        *within, "__range", *[F.coalesce(F.sum(f"__s_{x}").over(before), F.lit(0)).alias(f"__b_{x}") for x in names]
    )
    if not within:
        base = F.broadcast(base)  # one row for each range at most
    local = W.partitionBy(*within, "__range").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(base, [*within, "__range"])
    own = {x: F.col(f"__b_{x}") + F.coalesce(F.sum(f"__v_{x}").over(local), F.lit(0)) for x in names}
    return joined.select(*df.columns, *[c.alias(x) for x, c in own.items()])


def running_total(
    df: DataFrame, key: str, value: Column, out: str, within: tuple[str, ...] = (), ties: tuple[str, ...] = ()
) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, key, {out: value}, within, ties)


def file_layout(files: DataFrame, key: str, size: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """``offset`` of each file in the stream: the sizes of those before it."""
    return running_total(files.withColumn("size", size.cast("bigint")), key, F.col("size"), "offset", within)


def block_overlap(layout: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """A row for each block a file touches: the range of the file's bytes there and their place in the block."""
    o, s, b = F.col("offset"), F.col("size"), F.lit(block_size)
    last = F.floor((o + s - 1) / b)
    spread = layout.where("size > 0").withColumn("block_id", F.explode(F.sequence(F.floor(o / b), last)))
    start = F.greatest(o, F.col("block_id") * b)
    stop = F.least(o + s, (F.col("block_id") + 1) * b)
    return spread.withColumns(
        {"in_block": start - F.col("block_id") * b, "in_file": start - o, "length": stop - start}
    )


def block_fanout(layout: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """How many files each block holds, and how many of its bytes they use."""
    return (
        block_overlap(layout, block_size)
        .groupBy("block_id")
        .agg(F.count("*").alias("n_files"), F.sum("length").alias("used_bytes"))
    )


def stored_size(compressed: Column, block_size: int = BLOCK_SIZE) -> Column:
    """A block is stored raw if compressing it failed (null or negative) or gained nothing."""
    return F.when((compressed < 0) | (compressed >= block_size) | compressed.isNull(), block_size).otherwise(compressed)


def offset_records(blocks: DataFrame, within: tuple[str, ...] = (), slots: int = SLOTS) -> DataFrame:
    """``(record_id, base, sizes)``: blocks' stored sizes less one, ``slots`` to a record, unused ones 0.

    ``blocks`` has block_id and stored.
    """
    placed = running_total(blocks, "block_id", F.col("stored"), "at", within)
    rec = F.floor(F.col("block_id") / slots).alias("record_id")
    packed = placed.groupBy(*within, rec).agg(
        F.min("at").alias("base"),
        F.sort_array(F.collect_list(F.struct((F.col("block_id") % slots).alias("slot"), "stored"))).alias("s"),
    )
    sizes = F.transform("s", lambda x: (x["stored"] - 1).cast("int"))
    full = F.concat(sizes, F.array_repeat(F.lit(0), F.lit(slots) - F.size("s")))
    return packed.select(*within, "record_id", "base", full.alias("sizes"))


def block_offsets(records: DataFrame, within: tuple[str, ...] = (), slots: int = SLOTS) -> DataFrame:
    """Place and stored size of each slot of each record, unused ones included."""
    each = records.select(*within, "record_id", "base", "sizes", F.posexplode("sizes").alias("slot", "less_one"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("slot")), F.lit(0).cast("bigint"), lambda a, x: a + x + 1)
    return each.select(
        *within,
        (F.col("record_id") * slots + F.col("slot")).alias("block_id"),
        (F.col("base") + before).alias("at"),
        (F.col("less_one") + 1).cast("bigint").alias("stored"),
    )
