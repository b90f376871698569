"""Arithmetic of a compressor's matches as column expressions: offset histories, hashes, codes, table sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The history's length and beginning, multipliers of the hash by match length, bounds of
# an entropy table's size, and how far apart the least lengths of consecutive codes are.
HISTORY = (1, 4, 8)
PRIMES = {4: 2654435761, 5: 889523592379, 6: 227718039650203, 7: 58295818150454627, 8: 0xCF1BBCDCB7A56463}
LEAST_LOG, DEFAULT_LOG, MOST_LOG = 5, 11, 12
LITERAL_BITS = [0] * 16 + [1, 1, 1, 1, 2, 2, 3, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
MATCH_BITS = [0] * 32 + [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
U32 = 0xFFFFFFFF


def least_lengths(bits: list[int]) -> list[int]:
    """The least length of each code: each holds as many as its extra bits tell apart."""
    out = [0]
    for b in bits[:-1]:
        out.append(out[-1] + (1 << b))
    return out


def log2(value: Column) -> Column:
    """Whole binary logarithm; 0 for 0."""
    return F.greatest(F.char_length(F.bin(value.cast("bigint"))) - 1, F.lit(0))


def _code(length: Column, bits: list[int]) -> Column:
    table = F.lit(least_lengths(bits)).cast("array<bigint>")
    return F.size(F.filter(table, lambda x: x <= length)) - 1


def literal_code(length: Column) -> Column:
    """Code of a number of literals."""
    return _code(length, LITERAL_BITS)


def match_code(length: Column) -> Column:
    """Code of a match length less three."""
    return _code(length, MATCH_BITS)


def extra_bits(code: Column, kind: str) -> Column:
    """Bits that follow a literal or match code."""
    return F.get(F.lit({"literal": LITERAL_BITS, "match": MATCH_BITS}[kind]), code)


def offset_code(off_base: Column) -> Column:
    return log2(off_base)


def to_off_base(offset: Column) -> Column:
    """A real offset as it is stored: above the codes of the history. Zero raises."""
    return F.when(offset > 0, offset + len(HISTORY)).otherwise(F.raise_error(F.lit("offset must be 1 or more")).cast("bigint"))


def is_repeat(off_base: Column) -> Column:
    return off_base.between(1, len(HISTORY))


def raw_offset(history: Column, off_base: Column, no_literals: Column) -> Column:
    """The offset that a stored value means: real, or one of the history, which moves up by one where no
    literals come before; beyond its end is the first less one, 32 bits wide."""
    at = off_base - 1 + no_literals.cast("int")
    less = (F.get(history, F.lit(0)) - 1).bitwiseAND(F.lit(U32))
    return F.when(~is_repeat(off_base), off_base - len(HISTORY)).when(at == len(HISTORY), less).otherwise(F.get(history, at.cast("int")))


def next_history(history: Column, off_base: Column, no_literals: Column) -> Column:
    """The three last offsets after a sequence: the one it used comes first, once."""
    at = off_base - 1 + no_literals.cast("int")
    used, (a, b, c) = raw_offset(history, off_base, no_literals), (F.get(history, F.lit(i)) for i in range(3))
    third = F.when(is_repeat(off_base) & (at < 2), c).otherwise(b)
    return F.when(is_repeat(off_base) & (at == 0), history).otherwise(F.array(used, a, third))


def histories(sequences: Column) -> Column:
    """The history after all of ``array<struct<off_base, no_literals>>``, from its beginning."""
    begin = F.array(*[F.lit(x).cast("bigint") for x in HISTORY])
    return F.aggregate(sequences, begin, lambda h, s: next_history(h, s["off_base"].cast("bigint"), s["no_literals"]))


def hash_bytes(data: Column, at: Column, hash_log: int, k: int) -> Column:
    """``hash_log`` bits from ``k`` (4 to 8) bytes of a BINARY at a 0-based place, zeros past its end.

    The product modulo 64 bits is put together from parts of 16, so that nothing overflows.
    """
    wide = 4 if k <= 4 else k
    hex_ = F.rpad(F.hex(F.substring(data, at + 1, F.lit(wide))), 2 * wide, "0")
    byte = lambda i: F.conv(F.substring(hex_, 2 * i + 1, 2), 16, 10).cast("bigint")
    size = 32 if wide == 4 else 64
    # little-endian, with the bytes pushed to the top where fewer than eight are hashed
    place = lambda i: i + (0 if wide == 4 else 8 - wide)
    n = size // 16
    limbs = [F.lit(0).cast("bigint") for _ in range(n)]
    for i in range(wide):
        limbs[place(i) // 2] = limbs[place(i) // 2] + byte(i) * (1 << 8 * (place(i) % 2))
    prime = [PRIMES[wide] >> 16 * i & 0xFFFF for i in range(n)]
    carry, out = F.lit(0).cast("bigint"), []
    for i in range(n):
        total = reduce(lambda x, y: x + y, [limbs[j] * prime[i - j] for j in range(i + 1)], carry)
        out.append(total.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(total, 16)
    top = out[-1] * 65536 + out[-2]
    return F.shiftright(top, 32 - hash_log)


def least_table_log(size: Column, most_symbol: Column) -> Column:
    return F.least(log2(size) + 1, log2(most_symbol) + 2)


def table_log(size: Column, most_symbol: Column, most: int = 0, minus: int = 2) -> Column:
    """Size of an entropy table for so many symbols: less for little input, but enough for the alphabet.
    One symbol or none has no table: null."""
    by_size = log2(size - 1) - minus
    wanted = F.lit(most or DEFAULT_LOG)
    cut = F.when((by_size >= 0) & (by_size < wanted), by_size).otherwise(wanted)
    log = F.greatest(cut, least_table_log(size, most_symbol))
    return F.when(size > 1, F.least(F.greatest(log, F.lit(LEAST_LOG)), F.lit(MOST_LOG)).cast("int"))
