"""Windows-1252 text, which Spark cannot encode itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes 0x80 to 0x9F; the five undefined ones stand for control characters.
HIGH = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
TABLE = {ord(c): 0x80 + i for i, c in enumerate(HIGH)}


def encode_1252(text: str) -> bytes:
    """Each UTF-16 unit is one byte; one that has none is ``?``, so a pair of surrogates is two."""
    out = bytearray()
    for c in map(ord, text):
        if c < 0x80 or 0xA0 <= c <= 0xFF:
            out.append(c)
        elif c > 0xFFFF:
            out += b"??"
        else:
            out.append(TABLE.get(c, 0x3F))
    return bytes(out)


def decode_1252(data: bytes) -> str:
    return "".join(HIGH[b - 0x80] if 0x80 <= b < 0xA0 else chr(b) for b in data)


def to_1252(text: Column) -> Column:
    run = lambda col: pa.array([None if v is None else encode_1252(v) for v in col.to_pylist()], pa.binary())
    return F.arrow_udf(run, T.BinaryType())(text)


def from_1252(data: Column) -> Column:
    run = lambda col: pa.array([None if v is None else decode_1252(v) for v in col.to_pylist()], pa.string())
    return F.arrow_udf(run, T.StringType())(data)
