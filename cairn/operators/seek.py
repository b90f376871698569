"""Seek tables: frames of a compressed file, and lookups of an offset among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.binary import le_bytes, le_uint
from cairn.operators.layout import running_total, running_totals

# Fixed values of the seek table format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
MAX_FRAMES = 0x08000000
HEADER, INTEGRITY, ENTRY, CHECKED_ENTRY = 8, 9, 8, 12


def seek_table(frames: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``frames(frame_id, c_size, d_size)`` with start and end on both axes."""
    starts = running_totals(frames, "frame_id", {"c_start": F.col("c_size"), "d_start": F.col("d_size")}, within)
    return starts.withColumns({"c_end": F.col("c_start") + F.col("c_size"), "d_end": F.col("d_start") + F.col("d_size")})


def frames_of(files: DataFrame, key: str, size: Column, frame_size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Frames of ``frame_size`` bytes of each file, the last shorter; an empty file has one empty frame."""
    n = F.greatest(F.ceil(size / frame_size), F.lit(1)).cast("bigint")
    each = files.select(key, *keep, size.cast("bigint").alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_id"))
    return each.select(
        key,
        *keep,
        "frame_id",
        F.greatest(F.least(F.col("size") - F.col("frame_id") * frame_size, F.lit(frame_size)), F.lit(0)).alias("d_size"),
    )


def numbered_frames(files: DataFrame, key: str, size: Column, frame_size: int) -> DataFrame:
    """The frames of all files in order of ``key`` as those of one table: ``frame_id`` counts through.
    Frames are counted by file before they are listed."""
    sized = files.select(key, size.cast("bigint").alias("__size"))
    n = F.greatest(F.ceil(F.col("__size") / frame_size), F.lit(1))
    counted = running_total(sized, key, n, "__first")
    each = frames_of(counted, key, F.col("__size"), frame_size, ("__first",))
    return each.select(key, (F.col("__first") + F.col("frame_id")).alias("frame_id"), "d_size")


def frame_at(
    offsets: DataFrame,
    table: DataFrame,
    offset: str = "offset",
    axis: str = "d",
    bin_size: int = 1 << 20,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """The frame that holds each offset; one past the end finds the last frame, a table without
    frames none. With ``within``, offsets meet the table of their own file.

    The range condition is made an equality first: frames are listed under each bin they touch, so
    offsets meet only frames of their own bin. Empty frames hold nothing.
    """
    start, end = f"{axis}_start", f"{axis}_end"
    last = table.groupBy(*within).agg(F.max(end).alias("__total"), F.max("frame_id").alias("__last"))
    full = table.where(F.col(end) > F.col(start))
    bins = F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))
    listed = full.select(*within, "frame_id", start, end, F.explode(bins).alias("__bin"))
    asked = offsets.join(last, list(within)) if within else offsets.join(F.broadcast(last)).where("__last IS NOT NULL")
    asked = asked.withColumn("__bin", F.floor(F.col(offset) / bin_size)).alias("q")
    inside = (
        (F.col("q.__bin") == F.col("t.__bin"))
        & (F.col(f"q.{offset}") >= F.col(f"t.{start}"))
        & (F.col(f"q.{offset}") < F.col(f"t.{end}"))
    )
    for c in within:
        inside = inside & (F.col(f"q.{c}") == F.col(f"t.{c}"))
    found = asked.join(listed.alias("t"), inside, "left")
    id_ = F.when(F.col(f"q.{offset}") >= F.col("q.__total"), F.col("q.__last")).otherwise(F.col("t.frame_id"))
    return found.select(*[F.col(f"q.{c}") for c in offsets.columns], id_.alias("frame_id"))


def summary(table: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Frames, bytes on both axes, largest frames and compression ratio (0 for an empty table)."""
    c, d = F.coalesce(F.sum("c_size"), F.lit(0)), F.coalesce(F.sum("d_size"), F.lit(0))
    return table.groupBy(*within).agg(
        F.count("*").alias("n_frames"),
        c.alias("total_comp"),
        d.alias("total_decomp"),
        F.coalesce(F.max("c_size"), F.lit(0)).alias("max_comp"),
        F.coalesce(F.max("d_size"), F.lit(0)).alias("max_decomp"),
        F.when(c > 0, d / c).otherwise(0.0).alias("ratio"),
    )


def frame_range(table: DataFrame, offset: int, length: int) -> DataFrame:
    """Frames that a range of decompressed bytes touches, with the slice of each that it takes."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    stop = offset + length
    touched = table.where((F.col("d_start") < stop) & (F.col("d_end") > offset))
    start = F.greatest(F.col("d_start"), F.lit(offset))
    return touched.withColumns(
        {"skip": start - F.col("d_start"), "take": F.least(F.col("d_end"), F.lit(stop)) - start}
    )


def frame_sizes(starts: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Sizes from cumulative ends: each end less the one before it."""
    w = W.partitionBy(*within).orderBy("frame_id")
    return starts.withColumns(
        {
            "c_size": F.col("c_end") - F.lag("c_end", 1, 0).over(w),
            "d_size": F.col("d_end") - F.lag("d_end", 1, 0).over(w),
        }
    )


def serialize(table: DataFrame, within: tuple[str, ...] = (), head: bool = False) -> DataFrame:
    """``(table)`` as BINARY: a skippable frame; the integrity field follows the entries, or, with
    ``head``, comes before them."""
    entry = F.concat(le_bytes(F.col("c_size"), 4), le_bytes(F.col("d_size"), 4))
    got = table.withColumn("entry", entry).groupBy(*within).agg(
        F.count("*").alias("n"), F.expr("listagg(entry) WITHIN GROUP (ORDER BY frame_id)").alias("es")
    )
    entries = F.coalesce("es", F.unhex(F.lit("")))
    integrity = F.concat(le_bytes(F.col("n"), 4), F.unhex(F.lit("00")), le_bytes(F.lit(SEEKABLE_MAGIC), 4))
    header = F.concat(le_bytes(F.lit(SKIPPABLE_MAGIC), 4), le_bytes(F.col("n") * ENTRY + INTEGRITY, 4))
    body = F.concat(integrity, entries) if head else F.concat(entries, integrity)
    return got.select(*within, F.concat(header, body).alias("table"))


def parse(files: DataFrame, data: str = "data", head: bool = False) -> DataFrame:
    """``files`` with ``failure`` (null if sound) and ``frames``, an array of (frame_id, c_size, d_size).

    The table is at the end of ``data``, or, with ``head``, at its beginning, trailing bytes then
    ignored. Entries with checksums are read, their checksums skipped.
    """
    raw, n = F.col(data), F.octet_length(data)
    at = F.lit(HEADER) if head else n - INTEGRITY
    short = n < (HEADER + INTEGRITY if head else INTEGRITY)
    flags = le_uint(raw, at + 4, 1)
    rows = files.select(
        "*",
        short.alias("__short"),
        F.when(~short, le_uint(raw, at, 4)).alias("__n"),
        F.when(~short, le_uint(raw, at + 5, 4)).alias("__magic"),
        F.when(~short, flags).alias("__flags"),
    )
    width = F.when(F.col("__flags").bitwiseAND(F.lit(0x80)) != 0, CHECKED_ENTRY).otherwise(ENTRY)
    size = F.col("__n") * width + HEADER + INTEGRITY
    start = F.lit(0) if head else n - size
    whole = size <= n
    skip_magic = F.when(whole, le_uint(raw, start, 4))
    skip_size = F.when(whole, le_uint(raw, start + 4, 4))
    failure = (
        F.when(F.col("__short"), "TooShort")
        .when(F.col("__magic") != SEEKABLE_MAGIC, "BadMagic")
        .when(F.shiftright("__flags", 2).bitwiseAND(F.lit(0x1F)) != 0, "ReservedBits")
        .when(F.col("__n") > MAX_FRAMES, "TooManyFrames")
        .when(~whole, "Truncated")
        .when(skip_magic != SKIPPABLE_MAGIC, "BadSkippableMagic")
        .when(skip_size + HEADER != size, "SizeMismatch")
    )
    first = start + (HEADER + INTEGRITY if head else HEADER)
    # Bound once for all entries: else the planner may put what makes the bytes into each of them.
    bound = F.array(F.struct(raw.alias("raw"), first.alias("first"), width.alias("width"), F.col("__n").alias("n")))

    def entries(b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("bigint"), b["n"] - 1),
            lambda i: F.struct(
                i.alias("frame_id"),
                le_uint(b["raw"], b["first"] + i * b["width"], 4).alias("c_size"),
                le_uint(b["raw"], b["first"] + i * b["width"] + 4, 4).alias("d_size"),
            ),
        )

    none = F.array().cast("array<struct<frame_id:bigint,c_size:bigint,d_size:bigint>>")
    sound = failure.isNull() & (F.col("__n") > 0)
    frames = F.when(sound, F.get(F.transform(bound, entries), F.lit(0))).otherwise(none)
    return rows.withColumns({"failure": failure, "frames": frames}).drop("__short", "__n", "__magic", "__flags")
