"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distance verified."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import connected_components, map_batches, materialize, release

SEED = 42
#: Shingles whose bits are counted at once; bounds memory for any text.
BLOCK = 1 << 18
#: Choices of blocks joined at once.
KEYS = 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included."""
    parts = text.translate(LOWER).split()  # bytes.split() splits at 0x20 and 0x09-0x0D
    if not parts:
        return []
    h, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return [h(joined, SEED)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-words])]
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hash, no bit."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """The majority of the hashes of a text's shingles, repeats included."""
    return majority(np.array(shingle_hashes(text, words), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` per row, fp as a signed 64-bit integer. Null text has no word: zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_binary())
        fps = np.array([fingerprint(t.as_py() or b"", words) for t in texts], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), one, f"id {kind}, fp bigint")


def bits(col: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(col, at).bitwiseAND(F.lit((1 << n) - 1))


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(offset, length) of ``parts`` nearly equal blocks of ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fps: DataFrame, blocks: list[tuple[int, int]], combos: list[tuple[int, ...]]) -> DataFrame:
    """``(combo, key, fp)``: what each fingerprint has in each choice of blocks; ``combo`` is a bit mask."""
    keys = []
    for chosen in combos:
        key, used = F.lit(0).cast("bigint"), 0
        for at, n in (blocks[i] for i in chosen):
            key, used = key.bitwiseOR(F.shiftleft(bits(F.col("fp"), at, n), used)), used + n
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("combo"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.combo", "k.key", "fp")


def enough_blocks(n: int, distance: int) -> int:
    """How many blocks a key takes so that it has ten bits more than ``n`` fingerprints need to differ:
    by chance alone, keys then bring together fewer pairs than there are fingerprints."""
    wanted = math.log2(max(2, n)) + 10
    return next((a for a in range(2, 9) if 64 * a // (distance + a) >= wanted), 9)


def links(fps: DataFrame, distance: int = 3, agree: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of distinct ``fps(fp)`` at ``distance`` bits or fewer, whose components are those
    of all such pairs.

    There are ``distance + agree`` blocks. Two fingerprints that differ in at most ``distance`` bits
    have ``agree`` blocks in common, so they share a key for at least one choice of so many; without
    ``agree`` the number of fingerprints decides. Within a key, all are first held against its least
    and its greatest fingerprint. What that links is one component, so then only pairs of different
    components are compared: a dense cluster gives a link or two for each key, not all its pairs.
    """
    agree = enough_blocks(fps.count(), distance) if agree is None else agree
    blocks = cuts(64, distance + agree)
    combos = list(combinations(range(len(blocks)), agree))
    held = materialize(
        reduce(DataFrame.unionByName, [shared_keys(fps, blocks, combos[i : i + KEYS]) for i in range(0, len(combos), KEYS)]),
        "held",
    )
    ends = held.groupBy("combo", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    stars = held.join(ends, ["combo", "key"]).select(F.explode(F.array("least", "most")).alias("a"), F.col("fp").alias("b"))
    first = materialize(stars.where((F.col("a") != F.col("b")) & near("a", "b", distance)).distinct(), "links")
    roots = connected_components(first)
    at = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = materialize(at, "rooted")
    for done in (held, roots):
        release(done)
    mixed = at.groupBy("combo", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_ = at.join(mixed.select("combo", "key"), ["combo", "key"], "left_semi")
    rest = materialize(across(open_, blocks, distance), "links")
    release(at)
    both = first.unionByName(rest)
    both._cairn_parts = (first, rest)
    return both


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def shared_keys(fps: DataFrame, blocks: list[tuple[int, int]], combos: list[tuple[int, ...]]) -> DataFrame:
    """The keys that more than one fingerprint has; they are counted before the shuffle."""
    keys = block_keys(fps, blocks, combos)
    shared = keys.groupBy("combo", "key").count().where("count > 1").select("combo", "key")
    return keys.join(shared, ["combo", "key"])


def across(held: DataFrame, blocks: list[tuple[int, int]], distance: int) -> DataFrame:
    """Links between fingerprints that have a key in common and different roots.

    The join's condition verifies the distance, and that the key is of the first blocks the pair has
    in common, so each link leaves it once and nothing else does.
    """
    a, b = held.alias("a"), held.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = F.lit(0)
    for i, (at, n) in enumerate(blocks):
        same = same + F.when(bits(differ, at, n) == 0, 1 << i).otherwise(0)
    # of the blocks up to the key's last one, those in common are the key's
    reach = F.call_function("shiftleft", F.lit(1), F.length(F.bin("a.combo"))) - 1
    pairs = a.join(
        b,
        (F.col("a.combo") == F.col("b.combo"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.col("a.root") != F.col("b.root"))
        & near("a.fp", "b.fp", distance)
        & (same.bitwiseAND(reach) == F.col("a.combo")),
    )
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distance: int = 3,
    agree: int | None = None,
) -> DataFrame:
    """``(id, fp, component)`` per row: component is the smallest id that links reach.

    Links hold between fingerprints of at most ``distance`` differing bits. Copies share one
    fingerprint and are one node, so their number adds no pair. Null text counts as empty; rows
    without a word share fingerprint zero. A row with a null id keeps its fingerprint and never
    names a component (null only if no id in its component is known). Repeated rows stay repeated;
    other columns are ignored; an empty table gives no row.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = links(nodes.select("fp"), distance, agree)
    roots = connected_components(found)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    names = materialize(rooted.select("fp", "root").join(named, "root").select("fp", "component"), "names")
    for done in (nodes, found, roots):
        release(done)
    return fp.join(names, "fp").select("id", "fp", "component")
