"""Byte statistics of payloads and blocks; bytes are counted by Arrow batch, the rest is expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of payloads that are counted together; a longer payload is counted alone.
TOGETHER = 4 << 20


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive payloads of about ``TOGETHER`` bytes."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= TOGETHER or i + 1 - start >= 1024:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice of payloads, and how many each has; null has none."""
    raw = [v.as_buffer() if v.is_valid else b"" for v in col.cast(pa.large_binary())]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(v) for v in raw], np.int64)


def _counted(payloads: DataFrame, count: Callable[[pa.Array], tuple], names: str) -> DataFrame:
    """``(key, names...)`` for the payloads of each Arrow batch, by ``count``: which payload, and columns."""
    kind = payloads.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, z in _runs(sizes):
                of, *cols = count(b.column(1)[i:z])
                got = [b.column(0).take(pa.array(of + i)), *(pa.array(c, pa.int64()) for c in cols)]
                yield pa.RecordBatch.from_arrays(got, ["key", *names.split()])

    return payloads.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} bigint" for n in names.split()))


def byte_rows(payloads: DataFrame, key: str, data: Column) -> DataFrame:
    """``(key, byte, n)``: each payload's bytes counted, in one row per distinct byte. A batch of
    payloads is counted at once, so a payload sends 256 rows at most."""

    def count(col: pa.Array) -> tuple:
        flat, sizes = _joined(col)
        table = np.bincount(np.repeat(np.arange(len(sizes)) * 256, sizes) + flat, minlength=256 * len(sizes))
        at = np.flatnonzero(table)
        return at >> 8, at & 255, table[at]

    each = _counted(payloads.select(F.col(key).alias("key"), data.alias("data")), count, "byte n")
    got = each.groupBy(F.col("key").alias(key), F.col("byte").cast("int").alias("byte"))
    return got.agg(F.sum("n").alias("n"))


def histogram(payloads: DataFrame, data: Column) -> DataFrame:
    """Bytes of all payloads together: ``(byte, n)``. Each batch sends 256 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.zeros(256, np.int64)
            for v in b.column(0).cast(pa.large_binary()):
                if v.is_valid:
                    table += np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["byte", "n"])

    each = payloads.select(data.alias("data")).mapInArrow(run, "byte int, n bigint")
    return each.groupBy("byte").agg(F.sum("n").alias("n"))


def cardinality(counts: DataFrame, key: str) -> DataFrame:
    """Distinct bytes, the largest count and the total of each payload."""
    return counts.groupBy(key).agg(
        F.count("*").alias("n_symbols"), F.max("n").alias("largest"), F.sum("n").alias("total")
    )


def is_uniform(counts: DataFrame, key: str) -> DataFrame:
    """Payloads of one repeated byte."""
    return cardinality(counts, key).select(key, (F.col("n_symbols") == 1).alias("uniform"))


def entropy(counts: DataFrame, key: str) -> DataFrame:
    """Shannon bits per byte and in all."""
    per = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln(F.col("n"))).alias("nlogn"))
    bits = (F.col("total") * F.ln("total") - F.col("nlogn")) / F.ln(F.lit(2.0))
    return per.select(key, "total", (bits / F.col("total")).alias("bits_per_byte"), bits.alias("bits"))


def inverse_log() -> list[int]:
    """256 times the binary logarithm of 256 / i, rounded down, for i from 1; 0 for i = 0."""
    from math import floor, log2

    return [0, *(floor(256 * log2(256 / i)) for i in range(1, 256)), 0]


def table_cost(counts: DataFrame, key: str) -> DataFrame:
    """Whole bits from the table of inverse logarithms: shares are 256ths, at least one."""
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    share = F.greatest(F.floor(256 * F.col("n") / F.col("total")).cast("int"), F.lit(1))
    cost = F.col("n") * F.get(F.lit(inverse_log()), share)
    return counts.join(total, key).groupBy(key).agg(F.shiftright(F.sum(cost), 8).alias("cost_bits"))


def cross_cost(counts: DataFrame, norm: DataFrame, key: str, accuracy_log: int) -> DataFrame:
    """Whole bits of coding counts by another table's shares ``norm(byte, share)``; a share of -1
    stands for less than one and counts as one. A byte without a share has no code: null."""
    share = F.when(F.col("share") == -1, 1).otherwise(F.col("share")) * (1 << (8 - accuracy_log))
    cost = F.col("n") * F.get(F.lit(inverse_log()), share.cast("int"))
    joined = counts.join(norm, "byte", "left")
    missing = F.bool_or(F.col("share").isNull() & (F.col("n") > 0))
    return joined.groupBy(key).agg(F.when(~missing, F.shiftright(F.sum(cost), 8)).alias("cost_bits"))


def coded_size(counts: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Bytes of coding counts with codes of ``lengths(byte, bits)``."""
    return (
        counts.join(lengths, "byte").groupBy(key).agg(F.shiftright(F.sum(F.col("n") * F.col("bits")), 3).alias("coded_bytes"))
    )


def fingerprints(payloads: DataFrame, key: str, data: Column, rate: int, hash_log: int) -> DataFrame:
    """``(key, bucket, n, events)``: hashed pairs of bytes, one in ``rate``, counted."""

    def count(col: pa.Array) -> tuple:
        flat, sizes = _joined(col)
        begin = np.cumsum(sizes) - sizes
        pairs = np.where(sizes >= 2, (sizes - 2) // rate + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), pairs)
        at = begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pairs) - pairs, pairs)) * rate
        value = flat[at].astype(np.int64) + 256 * flat[at + 1].astype(np.int64)
        bucket = (value * 0x9E3779B9 & 0xFFFFFFFF) >> (32 - hash_log)
        found, n = np.unique(doc << hash_log | bucket, return_counts=True)
        of = found >> hash_log
        return of, found & (1 << hash_log) - 1, n, (sizes[of] - 1) // rate

    each = _counted(payloads.select(F.col(key).alias("key"), data.alias("data")), count, "bucket n events")
    got = each.groupBy(F.col("key").alias(key), F.col("bucket").cast("int").alias("bucket"))
    return got.agg(F.sum("n").alias("n"), F.max("events").alias("events"))


def merged(prints: DataFrame) -> DataFrame:
    """Fingerprints added up."""
    return prints.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))


def distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Weighted distance of each payload's fingerprint in ``a`` to its one in ``b``, over all buckets
    that either has: the sum of |n_a * events_b - n_b * events_a|."""
    left = a.select(key, "bucket", F.col("n").alias("na"))
    right = b.select(key, "bucket", F.col("n").alias("nb"))
    ea = a.groupBy(key).agg(F.max("events").alias("ea"))
    eb = b.groupBy(key).agg(F.max("events").alias("eb"))
    both = left.join(right, [key, "bucket"], "full").join(ea, key).join(eb, key)
    gap = F.abs(F.coalesce("na", F.lit(0)) * F.col("eb") - F.coalesce("nb", F.lit(0)) * F.col("ea"))
    return both.groupBy(key).agg(F.sum(gap).alias("distance"))
