"""Paths and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MAX_NAME = 0x7FFF
DEVICE = r"^(?i:CON|PRN|AUX|NUL|(?:COM|LPT)[1-9])$"


def components(path: Column) -> Column:
    """Names between ``/`` and ``\\``; repeated separators collapse, the empty path has none."""
    return F.filter(F.split(path, r"[/\\]"), lambda x: x != "")


def next_node(path: Column) -> Column:
    """(node, rest) of a path's first component, or null if it has none."""
    cut = F.regexp_extract(path, r"^[/\\]*([^/\\]+)[/\\]*(.*)$", 1)
    rest = F.regexp_extract(path, r"^[/\\]*([^/\\]+)[/\\]*(.*)$", 2)
    return F.when(cut != "", F.struct(cut.alias("node"), rest.alias("rest")))


def split_filename(path: Column) -> Column:
    """(directory, filename): the filename follows the last separator."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.struct(F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1).alias("directory"), name.alias("filename"))


def fold(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def same_name(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def sort_key(name: Column) -> Column:
    """Bytes by which siblings are ordered: folded, a prefix before what it begins."""
    return fold(name).cast("binary")


def prefixes(path: Column) -> Column:
    """Each directory on the way to a path, outermost first, and the path itself."""
    parts = components(path)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 0, steps).otherwise(F.array().cast("array<string>"))


def is_device_name(name: Column) -> Column:
    return F.substring_index(name, ".", 1).rlike(DEVICE)


def is_safe_name(name: Column) -> Column:
    """Whether an entry name may become a file name: one plain component, no drive, no device."""
    bad = (name == "") | name.isin(".", "..") | name.rlike(r"[/\\]") | name.rlike("^[A-Za-z]:") | is_device_name(name)
    return ~bad


def stays_inside(path: Column) -> Column:
    """Whether a relative path cannot leave the directory it is put in."""
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:") & ~F.exists(components(path), lambda x: x == "..")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def default_archive_name(directory: Column, suffix: str) -> Column:
    """Name of the archive of a directory: its last component without an extension, and ``suffix``."""
    last = F.regexp_extract(F.regexp_replace(directory, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.concat(stem(last), F.lit(suffix))


def default_extract_name(archive: Column) -> Column:
    return F.concat(stem(split_filename(archive)["filename"]), F.lit("_extracted"))


def suffix(path: Column) -> Column:
    """Extension with its dot, empty without one."""
    return F.regexp_extract(path, r"[^/\\]*?(\.[^./\\]+)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty without one."""
    return F.lower(suffix(path))
