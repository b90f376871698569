"""Parsed literals, modes, stages and size classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a byte size, aliases of a mode, extensions and stage weights.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GIB": 1 << 30}
MODES = {
    "auto": "Auto",
    "extract-archive": "ExtractArchive",
    "extract-arc": "ExtractArchive",
    "archive": "ExtractArchive",
    "extract-iso": "ExtractIso",
    "extract": "ExtractIso",
    "iso": "ExtractIso",
    "compress": "Compress",
}
ISO_EXTENSIONS = (".iso",)
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz")
STAGES = {
    "archive": [("7z", 0.0, 0.33), ("xiso", 0.33, 0.33), ("zar", 0.66, 0.34)],
    "iso": [("xiso", 0.0, 0.5), ("zar", 0.5, 0.5)],
    "directory": [("zar", 0.0, 1.0)],
}
TIERS = ((16 << 10, "Le16K"), (128 << 10, "Le128K"), (256 << 10, "Le256K"))
EXIT_CODES = {
    "ok": 0,
    "bad_usage": -1,
    "output_not_directory": -3,
    "output_directory_not_created": -4,
    "not_found": -10,
    "refused": -11,
    "extraction_failed": -12,
    "pack_failed": -13,
    "archive_entry_failed": -14,
    "input_not_readable": -15,
    "pack_output_failed": -16,
}
U64 = (1 << 64) - 1


def cases(value: Column, table: dict, otherwise=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(otherwise)


def byte_size(text: Column) -> Column:
    """Bytes of ``2M``, ``10 KiB``, ...: DECIMAL(38,0), null if it is none or exceeds 64 bits."""
    digits = F.regexp_extract(text, "^([0-9]+)", 1)
    unit = F.upper(F.regexp_replace(F.regexp_replace(text, "^[0-9]+", ""), r"\s", ""))
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    factor = cases(unit, UNITS).cast("decimal(10,0)")
    fits = (digits != "") & (F.char_length(number) <= 20)
    size = F.when(fits, number.cast("decimal(20,0)") * factor)
    return F.when(size <= F.lit(str(U64)).cast("decimal(20,0)"), size.cast("decimal(38,0)"))


def percent(line: Column) -> Column:
    """The first number before a ``%``, as a share from 0 to 1."""
    digits = F.regexp_extract(line, "([0-9]+)%", 1)
    small = F.char_length(F.regexp_replace(digits, "^0+(?=.)", "")) <= 9
    return F.when((digits != "") & small, F.least(digits.try_cast("bigint") / 100.0, F.lit(1.0)))


def process_mode(text: Column) -> Column:
    return cases(F.lower(F.trim(text)), MODES)


def accepts(mode: Column, suffix: Column, is_file: Column, is_dir: Column) -> Column:
    """Whether a mode takes an entry of a directory."""
    iso, archive = is_file & suffix.isin(*ISO_EXTENSIONS), is_file & suffix.isin(*ARCHIVE_EXTENSIONS)
    return (
        F.when(mode == "Auto", is_dir | iso | archive)
        .when(mode == "ExtractArchive", archive)
        .when(mode == "ExtractIso", iso)
        .when(mode == "Compress", is_dir)
        .otherwise(False)
    )


def input_kind(is_dir: Column, suffix: Column) -> Column:
    return F.when(is_dir, "directory").when(suffix.isin(*ISO_EXTENSIONS), "iso").otherwise("archive")


def stage_kind(mode: Column, is_dir: Column, suffix: Column) -> Column:
    """What weights an input's stages have; outside Auto there is one stage."""
    return (
        F.when(mode != "Auto", "all")
        .when(is_dir, "directory")
        .when(suffix.isin(*ARCHIVE_EXTENSIONS), "archive")
        .when(suffix.isin(*ISO_EXTENSIONS), "iso")
        .otherwise("directory")
    )


def rebase(kind: Column, stage: Column, local: Column) -> Column:
    """A stage's share as the item's: ``base + length * local``; an unknown stage's stays."""
    out = F.when((kind == "all") & (stage == "all"), local)
    for k, segments in STAGES.items():
        for name, base, length in segments:
            out = out.when((kind == k) & (stage == name), F.lit(base) + F.lit(length) * local)
    return out.otherwise(local)


def progress_ratio(bytes_done: Column, bytes_total: Column, files_done: Column, files_total: Column) -> Column:
    """By bytes if their total is known, else by files, else 1."""
    return (
        F.when(bytes_total > 0, bytes_done / bytes_total).when(files_total > 0, files_done / files_total).otherwise(1.0)
    )


def compress_bound(size: Column) -> Column:
    extra = F.when(size < 131072, F.shiftright(131072 - size, 11)).otherwise(0)
    return size + F.shiftright(size, 8) + extra


def min_gain(size: Column, strategy: int) -> Column:
    """Bytes a compressed block must save; ``strategy`` counts from 1 (fast) to 9 (btultra2)."""
    return F.shiftright(size, strategy - 1 if strategy >= 8 else 6) + 2


def size_tier(size: Column) -> Column:
    out = None
    for most, name in TIERS:
        out = F.when(size <= most, name) if out is None else out.when(size <= most, name)
    return out.otherwise("Default")


def exit_code(outcome: Column) -> Column:
    return cases(outcome, EXIT_CODES)
