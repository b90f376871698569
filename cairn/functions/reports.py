"""Text of reports as column expressions: private names taken out, JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, NAME = "%USERPROFILE%", "[user]"
#: Short escapes of a JSON string.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def sanitized(text: Column, user: str, profile: str) -> Column:
    """The profile's folder becomes a mark, whatever its case or slashes, and the user's name another,
    where it is a whole token: no letter or digit on either side."""
    if profile:
        for path in dict.fromkeys((profile, profile.replace("\\", "/"))):
            text = F.regexp_replace(text, "(?iu)" + _quoted(path), MARK)
    if user:
        # the mark steps aside, so that a name within it is not taken for the user's
        text = F.replace(text, F.lit(MARK), F.lit("\0"))
        text = F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{Nd}])" + _quoted(user) + r"(?![\p{L}\p{Nd}])", NAME)
        text = F.replace(text, F.lit("\0"), F.lit(MARK))
    return text


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    out = text
    for raw, safe in SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(safe))
    rare = out
    for c in sorted(set(map(chr, range(32))) - set(SHORT)):
        rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))
