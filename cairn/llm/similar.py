"""Near-duplicates by SimHash, made whole: every pair of shingle sets at or above a similarity is linked.

SimHash blocks bring together the texts whose fingerprints are close, which is most of what belongs
together; each candidate is verified on the whole sets. No Hamming distance that tells texts apart
finds all pairs at a similarity of 0.8, so a prefix filter finds the rest, among texts that SimHash
has not joined already: in any order of all shingles, two sets of Jaccard similarity ``t`` or more
share one of the first ``n - ceil(t n) + 1`` shingles of each. The order puts common shingles last,
then goes by hash; a sample decides which are common, which moves the cost and never the result.
Nothing is sampled, capped or left to chance but that shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import connected_components, map_arrow, map_batches, materialize, release
from cairn.llm.simhash import SEED, majority, shingle_hashes
from cairn.llm.simhash import links as close_fingerprints

LEAST = Fraction(4, 5)
#: Bits in which fingerprints may differ that SimHash brings together.
DISTANCE = 3
#: One text of so many tells which shingles are common: those in ``COMMON`` or more sampled texts.
SAMPLED, COMMON = 8, 3
#: Words of 64 parities each in a set's sketch.
SKETCH = 8
#: Sets of more shingles have a second sketch of so many words, which still tells large sets apart.
LARGE, WIDE = 300, 64
#: Most rows that are sent to every executor rather than shuffled.
SMALL = 1_000_000
#: So many of a node's least open keys tell the first key that it shares with another.
HEAD = 4
#: Pairs for each entry up to which all are compared, and the share of them that one more round has to settle.
LEFT, GAIN = 8, 0.2


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(np.array(shingle_hashes(text or b"", words), np.uint64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: Fraction = LEAST) -> np.ndarray:
    """The shingles of a set of which a similar set has at least one among its own."""
    n = len(hashes)
    take = n + 1 - -(-n * least.numerator // least.denominator) if n else 0
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = common[at] == hashes if len(common) else np.zeros(n, bool)
    last = hashes[known][np.lexsort((hashes[known], counts[at[known]]))] if known.any() else hashes[:0]
    return np.concatenate([hashes[~known], last])[:take]


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parities of the numbers of hashes in 64 ``size`` classes: those of two sets differ in no more places than the sets do."""
    odd = np.bincount((hashes & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles that many texts of the sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], ["h"])

    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    rows = map_arrow(some, run, "h bigint").groupBy("h").count().where(F.col("count") >= COMMON).toArrow()
    found = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["count"].to_numpy()[order]


def marks(rows: DataFrame, words: int, least: Fraction, kind: str) -> DataFrame:
    """``(id, h, node, fp, n, sketch, wide, prefix)`` per row of ``(id, h, text)``; ``node`` names a
    shingle set, ``fp`` is the fingerprint."""
    common, counts = common_shingles(rows, words)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.array(shingle_hashes(t.as_py() or b"", words), np.uint64) for t in batch.column(2).cast(pa.large_binary())]
        fps = np.array([majority(x) for x in hashes], np.uint64)
        sets = list(map(np.unique, hashes))
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(names.view(np.int64)),
                pa.array(fps.view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], longs),
                pa.array([sketch(s, WIDE) if len(s) > LARGE else s[:0].view(np.int64) for s in sets], longs),
                pa.array([prefix(s, common, counts, least).view(np.int64) for s in sets], longs),
            ],
            ["id", "h", "node", "fp", "n", "sketch", "wide", "prefix"],
        )

    longs = "array<bigint>"
    schema = f"id {kind}, h bigint, node bigint, fp bigint, n bigint, sketch {longs}, wide {longs}, prefix {longs}"
    return map_batches(rows, one, schema)


def near(a: str, b: str, least: Fraction) -> Column:
    """Whether sizes and sketches leave the similarity possible."""
    p, q = least.numerator, least.denominator
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(add, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)])
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (differ * (p + q) <= (n + m) * (q - p))


def near_wide(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs that the second sketches leave possible as well."""
    p, q = least.numerator, least.denominator
    x, y = (sketches.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"w_{k}")) for k in "ab")
    each = F.zip_with("w_a", "w_b", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    differ = F.aggregate(each, F.lit(0), lambda u, v: u + F.coalesce(v, F.lit(0)))
    possible = (F.size("w_a") != F.size("w_b")) | (differ * (p + q) <= (F.col("n_a") + F.col("n_b")) * (q - p))
    return pairs.join(x, "a").join(y, "b").where(possible).select("a", "b")


def verified(rows: DataFrame, own: DataFrame, pairs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    p, q = least.numerator, least.denominator
    pairs = materialize(pairs, "candidates")
    nodes = pairs.selectExpr("a AS node").unionByName(pairs.selectExpr("b AS node")).distinct()
    sets = sets_of(rows, own, nodes, words)
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    out = materialize(both.where(shared * (p + q) >= (F.size("of_a") + F.size("of_b")) * p).select("a", "b"), "links")
    for done in (pairs, sets):
        release(done)
    return out


def sets_of(rows: DataFrame, own: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)``: the whole sets of some nodes, each from one of its texts."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1).cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    of = materialize(own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")), "texts")
    few = F.broadcast(of) if of.count() <= SMALL else of
    texts = rows.join(few, "h").select("node", "text").dropDuplicates(["node"])
    out = materialize(map_batches(texts, one, "node bigint, hashes array<bigint>"), "sets")
    release(of)
    return out


def simhash_pairs(own: DataFrame, distance: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` of nodes by fingerprints of at most ``distance`` differing bits: each
    node with the least of its own fingerprint, and the least of fingerprints that are close."""
    fps = materialize(own.groupBy("node").agg(F.min("fp").alias("fp")), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = fps.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b")
    found = close_fingerprints(least.select("fp"), distance)
    x, y = (least.select(F.col("fp").alias(f"f_{k}"), F.col("least").alias(k)) for k in "ab")
    close = found.select(F.col("a").alias("f_a"), F.col("b").alias("f_b")).join(x, "f_a").join(y, "f_b").select("a", "b")
    out = materialize(same.unionByName(close), "candidates")
    for done in (fps, least, found):
        release(done)
    return out


def possible(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and sketches leave possible."""
    x, y = sketches.alias("x"), sketches.alias("y")
    some = pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & near("x", "y", least))
    return near_wide(some.select("a", "b"), sketches, least)


def links(rows: DataFrame, own: DataFrame, words: int, least: Fraction, distance: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of similarity ``least`` or more; their components are those of all such pairs.

    First come the pairs that SimHash finds, then each node is held against the least node of each key
    of the prefix filter. What those join is one component, so then only pairs of different
    components remain. Where one key still has many of them, its nodes are held against one node of
    its own again, another one each time, as long as that settles much of what is left: a large group
    of near copies costs some pairs for each entry, whichever of them are least. All pairs that then
    remain are compared.
    """
    flat = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    sketches = materialize(own.select("node", "n", "wide", *flat).dropDuplicates(["node"]), "sketches")
    near_by = simhash_pairs(own, distance)
    zero = verified(rows, own, possible(near_by, sketches, least), words, least)
    release(near_by)
    roots = connected_components(zero)
    joined = materialize(roots, "rooted")
    release(roots)

    entries = own.select(F.explode("prefix").alias("key"), "node")
    shared = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = materialize(shared.where("least <> most").select("key", "least"), "keys")
    held = materialize(entries.join(shared, "key").select("key", "node", "least").distinct(), "held")
    x, y = (joined.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    stars = held.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    apart = stars.join(x, "a", "left").join(y, "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)")
    stars = possible(apart.select("a", "b"), sketches, least)
    first = verified(rows, own, stars, words, least)

    roots = connected_components(zero.unionByName(first))
    nodes = sketches.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = materialize(held.select("key", "node").join(nodes, "node"), "rooted")
    release(held)
    mixed, left = mixed_keys(at)
    some = at.join(mixed, "key")
    head = F.slice(F.array_sort(F.collect_list("key")), 1, HEAD).alias("head")
    open_ = materialize(some.join(sketches.drop("wide"), "node").join(some.groupBy("node").agg(head), "node"), "open")
    release(at)
    found, most = [zero, first], LEFT * open_.count()
    while left > most:
        stars = near_wide(against_one(open_, len(found), least).distinct(), sketches, least)
        more = verified(rows, own, stars, words, least)
        found.append(more)
        again = connected_components(roots.selectExpr("node AS a", "root AS b").unionByName(more))
        at = open_.drop("root", "major").join(again, "node", "left").withColumn("root", F.coalesce("root", "node"))
        at = materialize(at, "rooted")
        release(mixed)
        before, (mixed, left) = left, mixed_keys(at)
        now = materialize(at.join(mixed, "key"), "open")
        for done in (at, open_, roots):
            release(done)
        open_, roots = now, again
        if left > (1 - GAIN) * before:
            break
    rest = near_wide(across(open_, least).distinct(), sketches, least)
    found.append(verified(rows, own, rest, words, least))
    both = materialize(reduce(DataFrame.unionByName, found), "links")
    for done in (*found, joined, shared, sketches, open_, mixed, roots):
        release(done)
    return both


def mixed_keys(at: DataFrame) -> tuple[DataFrame, int]:
    """``(key, major)`` of the keys with nodes of different components, ``major`` being the root that most
    of them have, and how many pairs of different components these keys have."""
    per = at.groupBy("key", "root").agg(F.count("node").alias("c"))
    square = F.col("c") * F.col("c")
    sums = [F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum(square).alias("same")]
    mixed = per.groupBy("key").agg(*sums).where("c > top.c")
    mixed = materialize(mixed.selectExpr("key", "top.root AS major", "(c * c - same) div 2 AS pairs"), "mixed")
    left = mixed.agg(F.sum(F.col("pairs").cast("double"))).first()[0]
    out = mixed.select("key", "major")
    out._cairn_parts = (mixed,)
    return out, left or 0


def against_one(open_: DataFrame, turn: int, least: Fraction) -> DataFrame:
    """Candidates ``(a, b)`` of different components: each key's nodes against one of them, another each turn."""
    chance = F.xxhash64("key", "node", F.lit(turn))
    one = F.min(F.struct(chance.alias("chance"), "node", "root", "n", *[f"s{i}" for i in range(SKETCH)])).alias("one")
    x, y = open_.groupBy("key").agg(one).select("key", "one.*").alias("x"), open_.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near("x", "y", least)
    return x.join(y, met).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def across(open_: DataFrame, least: Fraction) -> DataFrame:
    """Candidates ``(a, b)`` of different components, all that have a key in common.

    One of such a pair at least is not of the component that most of the key's nodes have, so the
    others need not be held against each other. A pair leaves the join at the first key that both
    ``head`` name, or, if they name none, at each key that it has in common.
    """
    x, y = open_.where("root <> major").alias("x"), open_.alias("y")
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
    apart = (F.col("x.root") != F.col("y.root")) & once
    named = F.array_min(F.array_intersect("x.head", "y.head"))
    met = (F.col("x.key") == F.col("y.key")) & apart & near("x", "y", least)
    pairs = x.join(y, met & (F.coalesce(named, F.col("x.key")) == F.col("x.key")))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    least: Fraction = LEAST,
    distance: int = DISTANCE,
) -> DataFrame:
    """``(id, h, root)`` per row: ``h`` is xxhash64 of the text, rows of one ``root`` are one group.

    Two rows are linked if the sets of their ``words``-word shingles have a Jaccard similarity of
    ``least`` or more; groups are the components of all links, whatever ``distance`` SimHash is given.
    A text of fewer words is one shingle; texts without a word are copies of each other, null included.
    Repeated rows stay repeated, ids are passed on as they are, null or not, other columns are
    ignored whatever their names, and an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    own = materialize(marks(rows, words, least, kind), "marks")
    found = links(rows, own, words, least, distance)
    roots = connected_components(found)
    named = own.select("id", "h", "node").join(roots, "node", "left")
    out = materialize(named.select("id", "h", F.coalesce("root", "node").alias("root")), "groups")
    for done in (own, found, roots):
        release(done)
    return out
