"""Removal of passages that repeat, byte by byte, by suffix arrays of anchored contexts.

Every string of ``length`` bytes holds at least one anchor: a k-gram whose hash is the least among
its neighbours, so equal strings have equal anchors at equal places. Texts that share an anchor are
brought together with the bytes around it, and only those. There a suffix array over words orders
what follows each anchor, another what precedes it; byte-exact common prefixes of neighbours in both
orders tell which strings around the anchor occur twice.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefix, groups
are processed in descending order along previous-smaller pointers, then each group's order is
emitted in one ascending pass. Nothing is renamed recursively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.chunks import runs
from cairn.llm.common import map_arrow, map_batches, materialize, release, setting

#: Items that one task orders together, on average, and most that one anchor may bring to a task.
ITEMS = 40_000
MOST_ITEMS = 40_000
#: Bytes of text scanned for anchors together.
TOGETHER = 1 << 18
ODD = 0x9E3779B97F4A7C15
FULL = np.uint64(2**64 - 1)


# Suffix array


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """Group number and previous-smaller pointer of each suffix of ``s``, whose last element is its
    one smallest. Numbers ascend as the groups' Lyndon words do; a group's number is the place of
    its first suffix in the suffix array."""
    n = len(s)
    order = np.argsort(np.asarray(s), kind="stable")
    values = np.asarray(s)[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    first = np.repeat(heads, np.diff(np.r_[heads, n]))
    group_of = np.empty(n, np.int64)
    group_of[order] = first
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    at, group, place = order.tolist(), group_of.tolist(), place_of.tolist()
    size = [0] * n
    for h, z in zip(heads.tolist(), np.diff(np.r_[heads, n]).tolist()):
        size[h] = z
    previous = [-1] * n
    end = n
    while end:
        start = group[at[end - 1]]
        pointed: dict[int, int] = {}
        members = at[start:end]
        if len(members) > 1:
            members.sort()
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:  # higher groups and earlier members know where to go
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        # A suffix followed by more of this group's words is greater than one followed by fewer.
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved = by_count[c]
            for p in moved:
                h = group[p]
                size[h] -= 1
                last = h + size[h]
                a, b = place[p], at[last]
                at[a], at[last] = b, p
                place[b], place[p] = a, last
            for p in moved:
                h = group[p]
                new = h + size[h]
                group[p] = new
                if new != h:
                    size[new] += 1
            # A group that was moved as a whole keeps its number and gets its size back.
            for p in moved:
                if group[p] + size[group[p]] <= place[p]:
                    size[group[p]] = place[p] - group[p] + 1
    return group, previous


def suffix_array(s: list[int]) -> list[int]:
    """The suffixes of ``s`` in ascending order; its last element must be its one smallest."""
    n = len(s)
    if not n:
        return []
    group, previous = lyndon_groups(s)
    free = list(range(n))
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:  # the next smaller suffix of each of these is out[i]
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return out


# Anchors


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


MASKS = np.random.default_rng(7).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
UP, DOWN = powers(ODD, 2 * TOGETHER), powers(pow(ODD, -1, 1 << 64), 2 * TOGETHER)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data)
    up, down = (UP, DOWN) if n < len(UP) else (powers(ODD, n + 1), powers(pow(ODD, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(MASKS[data] * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding(op: np.ufunc, h: np.ndarray, w: int, fill: np.uint64) -> np.ndarray:
    """``op`` over each window of ``w``, from running values within blocks of ``w``."""
    blocks = np.full(-(-len(h) // w) * w, fill)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, w)
    to_end = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    from_start = op.accumulate(blocks, axis=1).ravel()
    return op(to_end[: len(h) - w + 1], from_start[w - 1 : len(h)])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each k-gram within a text that is the least of some window of k-grams such
    as a string of ``length`` bytes holds. Windows across texts only add some."""
    w = length - k + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, k)
    h[h == FULL] -= np.uint64(1)
    over = (ends[:-1, None] - np.arange(1, k)).ravel()
    h[over[(over >= 0) & (over < len(h))]] = FULL
    low = sliding(np.minimum, h, w, FULL)
    wide = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    wide[w - 1 : w - 1 + len(low)] = low
    at = np.flatnonzero((sliding(np.maximum, wide, w, np.uint64(0)) == h) & (h != FULL))
    return at, h[at]


def context(text: bytes, at: int, length: int, k: int) -> tuple[bytes, bytes]:
    """What a string of ``length`` bytes that holds the anchor at ``at`` can hold before and from it."""
    return text[max(0, at + k - length) : at], text[at : at + length]


def anchored(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``(key, at, h, c)`` for each anchor of ``texts(key, text)``; c is a hash of the context."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, raw = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
        of, at, hs, cs = [], [], [], []
        for a, z in runs(list(map(len, raw)), TOGETHER):
            part = raw[a:z]
            ends = np.cumsum([len(t) for t in part])
            x, h = anchors(np.frombuffer(b"".join(part), np.uint8), ends, length, k)
            doc = np.searchsorted(ends, x, "right")
            x = x - np.r_[0, ends][doc]
            long = np.array([len(t) >= length for t in part])[doc]
            doc, x, h = doc[long], x[long], h[long]
            hash_ = xxhash.xxh3_64_intdigest
            back = length - k
            for d, p in zip(doc.tolist(), x.tolist()):
                t = part[d]
                low = p - back if p > back else 0
                cs.append(hash_(t[low : p + length], p - low))
            of.append(doc + a)
            at.append(x)
            hs.append(h)
        of = np.concatenate(of)
        cols = [
            keys.take(pa.array(of)),
            pa.array(np.concatenate(at), pa.int32()),
            pa.array(np.concatenate(hs).view(np.int64)),
            pa.array(np.array(cs, np.uint64).view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(cols, ["key", "at", "h", "c"])

    return map_batches(texts.select("key", "text"), one, "key binary, at int, h bigint, c bigint")


def contexts(wanted: DataFrame, texts: DataFrame, length: int, k: int) -> DataFrame:
    """``(h, c, before, after)`` of anchors ``wanted(key, at, h, c)``, cut out of their texts."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = batch.column(0).cast(pa.large_binary()).to_pylist()
        h, c, before, after = [], [], [], []
        for t, places in zip(texts_, batch.column(1).to_pylist()):
            for p in places:
                b, x = context(t, p["at"], length, k)
                h.append(p["h"])
                c.append(p["c"])
                before.append(b)
                after.append(x)
        cols = [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["h", "c", "before", "after"])

    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "h", "c")).alias("places"))
    joined = texts.select("key", "text").join(listed, "key").select("text", "places")
    return map_batches(joined, one, "h bigint, c bigint, before binary, after binary")


# Comparison


def ordered(words: np.ndarray) -> np.ndarray:
    """The rows of a matrix of word numbers in ascending order, by a suffix array of their string."""
    s = (words.ravel() + 1).tolist()
    s.append(0)
    order = np.array(suffix_array(s)[1:])
    return order[order % words.shape[1] == 0] // words.shape[1]


def common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in order, has in common with the one before it."""
    a, b = rows[order[:-1]], rows[order[1:]]
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(n, np.minimum(sizes[order[:-1]], sizes[order[1:]]))


def matrix(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def numbered(rows: np.ndarray, k: int) -> np.ndarray:
    """Words of k bytes by their rank among all of the rows' words."""
    words = np.ascontiguousarray(rows).view(f"S{k}").ravel()
    return np.unique(words, return_inverse=True)[1].reshape(len(rows), -1)


def repeats(before: list[bytes], after: list[bytes], length: int, k: int) -> np.ndarray:
    """For each item and each a up to ``length - k``: whether the string of ``length`` bytes that
    begins a bytes before its anchor is also another item's."""
    m, back = len(after), length - k
    wide, high = -(-length // k) * k, -(-back // k) * k
    right, left = matrix(after, wide), matrix([b[::-1] for b in before], high)
    right_size, left_size = np.array([len(x) for x in after]), np.array([len(x) for x in before])
    right_words = numbered(right, k)
    # Rows are filled up with zeros, which a text may hold too: of rows that are equal but for their
    # sizes the shorter comes first, so it never stands between two that have more in common.
    right_order = ordered(np.hstack([right_words, right_size[:, None]]))
    left_order = ordered(np.hstack([right_words[:, :1], numbered(left, k), left_size[:, None]]))
    anchor = right_words[:, 0]

    def shared(rows, sizes, order):
        n = common(rows, sizes, order)
        return np.where(anchor[order[1:]] == anchor[order[:-1]], n, -1)

    right_common, left_common = shared(right, right_size, right_order), shared(left, left_size, left_order)
    out = np.zeros((m, back + 1), bool)
    block_right, block_left = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for a in range(back + 1):
        block_right[right_order[1:]] = np.cumsum(right_common < length - a)
        block_left[left_order[1:]] = np.cumsum(left_common < a)
        fit = np.flatnonzero((right_size >= length - a) & (left_size >= a))
        pair = block_right[fit] * m + block_left[fit]
        by = np.argsort(pair, kind="stable")
        same = pair[by[1:]] == pair[by[:-1]]
        out[fit[by[1:][same]], a] = True
        out[fit[by[:-1][same]], a] = True
    return out


def compared(items: DataFrame, length: int, k: int) -> DataFrame:
    """``(h, c, mask)``: the items of each partition compared; items of one anchor lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        masks = np.packbits(repeats(t["before"].to_pylist(), t["after"].to_pylist(), length, k), axis=1)
        some = np.flatnonzero(masks.any(axis=1))
        mask = pa.array([masks[i].tobytes() for i in some.tolist()], pa.binary())
        cols = [t[x].combine_chunks().take(pa.array(some)) for x in "hc"]
        yield pa.RecordBatch.from_arrays([*cols, mask], ["h", "c", "mask"])

    return map_arrow(items, run, "h bigint, c bigint, mask binary")


def counted_strings(items: DataFrame, length: int, k: int) -> DataFrame:
    """The same for anchors with more contexts than a task should hold: each string around such an
    anchor is counted by its place and 128-bit hash, combined before the shuffle."""

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, c, at, string = [], [], [], []
        for r in batch.to_pylist():
            text, back = r["before"] + r["after"], len(r["before"])
            for a in range(max(0, length - len(r["after"])), min(back, length - k) + 1):
                h.append(r["h"])
                c.append(r["c"])
                at.append(a)
                string.append(xxhash.xxh3_128_digest(text[back - a : back - a + length]))
        cols = [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32()), pa.array(string, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["h", "c", "a", "string"])

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.zeros((batch.num_rows, length - k + 1), bool)
        for row, a in zip(bits, batch.column(2).to_pylist()):
            row[a] = True
        mask = pa.array([m.tobytes() for m in np.packbits(bits, axis=1)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], mask], ["h", "c", "mask"])

    each = materialize(map_batches(items, strings, "h bigint, c bigint, a int, string binary"), "strings")
    again = each.groupBy("h", "a", "string").count().where("count > 1").drop("count")
    places = each.join(again, ["h", "a", "string"]).groupBy("h", "c").agg(F.collect_list("a").alias("a"))
    return map_batches(places, packed, "h bigint, c bigint, mask binary")


def covered(size: int, places: list[dict], length: int, k: int) -> np.ndarray:
    """Which bytes of a text repeated strings cover. A null mask: all that hold the anchor repeat."""
    begins = np.zeros(size + 1, np.int32)
    back = length - k
    for p in places:
        at, mask = p["at"], p["mask"]
        if mask is None:
            begins[max(0, at - back) : max(0, min(at, size - length) + 1)] = 1
        else:
            begins[at - np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=back + 1))] = 1
    run = np.cumsum(begins)
    run[length:] -= run[:-length].copy()
    return run[:size] > 0


def repeated(docs: DataFrame, text_col: str, length: int, most_items: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(key, places)`` for each distinct text with repeated strings; keys are ``text_key``'s."""
    spark, k = docs.sparkSession, length // 4
    picked = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(
        F.octet_length("text") >= length
    )
    texts = materialize(picked.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n")), "texts")
    marks = materialize(anchored(texts, length, k), "anchors")
    # written first, so that a join may split an anchor that stands in very many places
    suspect = materialize(marks.groupBy("h").count().where("count > 1").select("h"), "anchors")
    copies = texts.where("n > 1").select("key", F.lit(True).alias("copied"))
    seen = materialize(marks.join(suspect, "h"), "suspects")
    release(marks)
    by_content = seen.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    by_content = materialize(by_content, "contents")
    varied = materialize(by_content.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "contents")
    counted = by_content.join(varied, "h", "left").where("n > 1 OR m IS NOT NULL")
    items = counted.where("m > 1")
    n_items, n_many = items.agg(F.count("*"), F.count_if(F.col("m") > most_items)).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_items // ITEMS))
    few, many = (
        contexts(x.select("one.key", "one.at", "h", "c"), texts, length, k)
        for x in (items.where(F.col("m") <= most_items), items.where(F.col("m") > most_items))
    )
    verdict = compared(few.repartition(parts, "h"), length, k)
    if n_many:
        verdict = verdict.unionByName(counted_strings(many, length, k))
    masks = materialize(verdict, "masks")
    whole = counted.where("n > 1").select("h", "c", F.lit(None).cast("binary").alias("mask"))
    partly = masks.join(counted.where("n > 1").select("h", "c"), ["h", "c"], "left_anti")
    verdicts = whole.unionByName(partly)
    places = seen.join(verdicts, ["h", "c"]).groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("places"))
    # A text that stands in several rows repeats as a whole: one place at its beginning says so.
    everywhere = copies.select("key", F.expr("array(struct(-1 AS at, cast(null AS binary) AS mask))").alias("places"))
    found = materialize(places.join(copies.select("key"), "key", "left_anti").unionByName(everywhere), "places")
    for df in (suspect, seen, by_content, varied, masks):
        release(df)
    return found, [texts]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    keep_row: bool = False,
    most_items: int = MOST_ITEMS,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` per row; ``keep_row`` adds ``row``, all columns as
    a struct, and makes ``kept`` a string, without the characters that lost a byte.

    Each byte is removed that a string of ``length`` bytes covers which also begins anywhere else,
    in the same text or another row's; ``kept`` is the rest. Null text counts as empty. A text
    shorter than ``length`` keeps all; one that stands in several rows loses all in each. A null id
    stays null; an empty table gives no row. Columns of any name ride along in ``row``. An anchor with
    more than ``most_items`` different contexts would be too much for one task, so its strings are
    dealt out over all and counted there.
    """
    k, kind = length // 4, docs.schema[id_col].dataType.simpleString()
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        found, used = repeated(docs, text_col, length, most_items)
    for df in used:
        release(df)
    row = [F.struct(*docs.columns).alias("row")] * keep_row
    rows = docs.select(
        text_key(F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(id_col).alias("id"),
        *row,
    )
    joined = rows.join(found, "key", "left").select("text", "places", "id", *(["row"] * keep_row))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, removed, spans, kept = [], [], [], []
        for t, places in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
            size.append(len(t))
            if not places:
                removed.append(0)
                spans.append(0)
                kept.append(t)
            elif places[0]["at"] < 0:
                removed.append(len(t))
                spans.append(1)
                kept.append(b"")
            else:
                gone = covered(len(t), places, length, k)
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
        rest = pa.array([t.decode("utf-8", "ignore") for t in kept]) if keep_row else pa.array(kept, pa.binary())
        cols = [*(pa.array(x, pa.int64()) for x in (size, removed, spans)), rest]
        names = ["n_bytes", "n_removed", "n_spans", "kept"]
        return pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], [*batch.schema.names[2:], *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[2:])
    return map_batches(joined, one, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {"string" if keep_row else "binary"}")


#: The same rows by counting every string of 200 bytes; texts are cut into overlapping parts first.
SQL = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
u AS (SELECT r, x, unnest(range(0, length(x) // 2 - 199, 500)) AS o FROM d),
v AS (SELECT r, o, substr(x, 2 * o + 1, 1398) AS part FROM u),
w AS (SELECT r, o, part, unnest(range(0, least(500, length(part) // 2 - 199))) AS q FROM v),
h AS (SELECT r, o + q AS p, md5_number(substr(part, 2 * q + 1, 400)) AS h FROM w),
m AS (SELECT r, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
i AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM i),
g AS (SELECT r, k, min(p) AS a, max(p) + 200 AS z FROM s GROUP BY r, k),
e AS (SELECT r, k, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY k) AS b, lead(a) OVER (PARTITION BY r ORDER BY k) AS nxt FROM g),
t AS (SELECT r, sum(z - a)::BIGINT AS removed, count(*)::BIGINT AS spans,
  string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY k) || any_value(substr(x, 2 * last + 1)) AS kept
  FROM (SELECT e.*, x, max(z) OVER (PARTITION BY e.r) AS last FROM e JOIN d USING (r)) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
