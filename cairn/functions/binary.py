"""Integers inside BINARY columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(data: Column, at, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at a 0-based place; 8 bytes give DECIMAL(20,0)."""
    raw = F.hex(F.substring(data, F.lit(at) + 1, F.lit(size)))
    text = F.conv(raw, 16, 10)
    return text.cast("decimal(20,0)") if size == 8 else text.cast("bigint")


def le_uint(data: Column, at, size: int) -> Column:
    """Little-endian unsigned integer: single bytes are put together in reverse."""
    parts = [F.hex(F.substring(data, F.lit(at) + i + 1, F.lit(1))) for i in reversed(range(size))]
    text = F.conv(F.concat(*parts), 16, 10)
    return text.cast("decimal(20,0)") if size == 8 else text.cast("bigint")


def be_bytes(value: Column, size: int) -> Column:
    """The value's low ``size`` bytes, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size)))


def le_bytes(value: Column, size: int) -> Column:
    parts = [be_bytes(F.shiftrightunsigned(value.cast("bigint"), 8 * i), 1) for i in range(size)]
    return F.concat(*parts)


def within(offset: Column, size: Column, total: Column) -> Column:
    """Whether a section lies in a file of ``total`` bytes; the sum is never formed, so nothing wraps."""
    return (offset <= total) & (size <= total - offset)


def low_high(low: Column, high: Column) -> Column:
    """48-bit value of 32 low and 16 high bits."""
    return low.cast("bigint") + F.shiftleft(high.cast("bigint"), 32)
