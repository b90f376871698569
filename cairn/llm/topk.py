"""Exact top-k search over binary codes: incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import materialize, release

WORD = 64


def sign_words(vec: Column, bits: int) -> Column:
    """Sign bits, 64 to a word: bit j of the code is 1 if component j is over 0 (null, NaN, none: 0)."""
    value = lambda j: F.coalesce(F.nanvl(F.get(vec, j).cast("double"), F.lit(0.0)), F.lit(0.0))

    def word(first: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(min(WORD, bits - first) - 1)),
            F.lit(0).cast("bigint"),
            lambda a, j: a.bitwiseOR(
                F.call_function("shiftleft", F.when(value(j + first) > 0, 1).otherwise(0).cast("bigint"), j)
            ),
        )

    return F.when(F.size(vec) > 0, F.array(*[word(i) for i in range(0, bits, WORD)]))


def hamming(a: Column, b: Column, bits: int) -> Column:
    words = range(-(-bits // WORD))
    return reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in words])


def segment(code: Column, at: int, width: int) -> Column:
    """``width`` bits of a code from bit ``at``, which may lie in two words."""
    i, shift = divmod(at, WORD)
    part = F.shiftrightunsigned(F.get(code, F.lit(i)), shift)
    if shift + width > WORD:
        part = part.bitwiseOR(F.shiftleft(F.get(code, F.lit(i + 1)), WORD - shift))
    return part.bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def reach(width: int, radii: list[int]) -> Column:
    """All differences of ``width`` bits that are exactly so large."""
    masks = [sum(1 << i for i in flipped) for r in radii for flipped in combinations(range(width), r)]
    return F.lit(masks).cast("array<int>")


def segment_cuts(n: int, bits: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment. A key has about eight entries: meeting one costs less than
    asking for another key. Below 13 bits the radii would grow in too coarse steps."""
    m = bits // max(13, round(math.log2(max(2, n))) - 3) + 1
    at = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def steps(segments: int, width: int) -> Iterator[tuple[list[int], list[int], int]]:
    """(radii, segments searched, total radius then covered).

    Once the first j + 1 segments have been searched to radius a and the rest to a - 1, a code at
    distance m * a + j or less must have been met: else its segments would add up to more.
    """
    half = segments // 2
    yield [0], list(range(segments)), segments - 1
    for a in range(1, width + 1):
        # While a radius asks for few keys, segments go together: a step costs more than its keys.
        if a < 4:
            groups = [range(half), range(half, segments)] if a < 3 else [range(segments)]
        else:
            groups = [range(j, j + 1) for j in range(segments)]
        for g in groups:
            yield [a], list(g), segments * a + g[-1]


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The k rows nearest to each query by Hamming distance of their codes, never the query itself.

    Returns ``(query_id, rank, id, distance)``; ties go to the smaller id. Radii grow segment by
    segment for the queries whose k-th verified distance is not yet covered, so the answer is
    exact. Copies of a code are one entry with its k + 1 smallest ids, which is all any query can
    need of them. Codes have as many bits as the longest vector has components; a shorter one's
    missing components count as not over 0. Rows with a null id or a null or empty vector are neither
    found nor asked for; repeated rows count once, and an id with several vectors once for each; a
    query with fewer than k other rows gets those; an empty table gives no row. Other columns are
    ignored, whatever their names.
    """
    longest = rows.select(F.size(vec_col).alias("n")).unionByName(queries.select(F.size(vec_col).alias("n")))
    bits = max(1, longest.agg(F.max("n")).first()[0] or 0)
    coded = materialize(_coded(rows, id_col, vec_col, bits), "codes")
    by_code = W.partitionBy("code").orderBy("id")
    index = materialize(
        coded.withColumn("n", F.row_number().over(by_code))
        .where(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "index",
    )
    asked = materialize(_coded(queries, id_col, vec_col, bits), "queries")
    # Each query also has a row without a code, which carries its bound from step to step.
    kind = index.schema["ids"].dataType.elementType.simpleString()
    marker = "code AS q", "cast(null AS array<bigint>) AS code", "0 AS n", f"cast(null AS {kind}) AS least", "-1 AS distance"
    found = materialize(asked.select("code").distinct().selectExpr(*marker, f"{bits} AS bound"), "found")
    active = found
    cuts = segment_cuts(index.count(), bits)
    segments, widest = len(cuts), max(w for _, w in cuts)
    part = lambda j: segment(F.col("code"), *cuts[j])
    entries = index.select(
        "code",
        F.size("ids").alias("n"),
        F.col("ids")[0].alias("least"),
        F.posexplode(F.array(*[part(j) for j in range(segments)])).alias("seg", "key"),
    )
    for radii, segs, covered in steps(segments, widest):
        probes = (
            active.withColumn("code", F.col("q"))
            .select(
                "q",
                "bound",
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(j).alias("seg"), part(j).alias("own"), reach(cuts[j][1], radii).alias("reach"))
                            for j in segs
                        ]
                    )
                ).alias("s"),
            )
            .select("q", "bound", "s.seg", "s.own", F.explode("s.reach").alias("mask"))
            .select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
        )
        distance = hamming(F.col("q"), F.col("code"), bits)
        # the planner takes exploded probes for as few as the queries and would broadcast them
        near = entries.where(F.col("seg").isin(segs)).hint("merge")
        met = probes.join(
            near, (probes.seg == near.seg) & (probes.key == near.key) & (distance <= probes.bound)
        ).select("q", "code", "n", "least", distance.alias("distance"))
        # All that follows needs a query's rows together, and they are brought together once.
        every = met.unionByName(found.drop("bound")).repartition("q").dropDuplicates(["q", "code"])
        best = W.partitionBy("q").orderBy("distance", "least", "code")
        top = every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 2)
        so_far = F.sum("n").over(best.rowsBetween(W.unboundedPreceding, 0))
        kth = F.min(F.when(F.col("so_far") >= k + 1, F.col("distance"))).over(W.partitionBy("q"))
        new = materialize(
            top.drop("place")
            .withColumn("so_far", so_far)
            .withColumn("bound", F.coalesce(kth, F.lit(bits)))
            .drop("so_far"),
            "found",
        )
        release(found)
        found = new
        active = found.where(F.col("code").isNull() & (F.col("bound") > covered))
        if covered >= bits or active.isEmpty():
            break
    release(coded)
    answers = found.where("code IS NOT NULL").select("q", "code", "distance").join(index, "code").select(
        "q", "distance", F.explode("ids").alias("id")
    )
    rank = W.partitionBy("query_id", "q").orderBy("distance", "id")
    return (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
        .join(answers, "q")
        .where("id <> query_id")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


def _coded(rows: DataFrame, id_col: str, vec_col: str, bits: int) -> DataFrame:
    coded = rows.select(F.col(id_col).alias("id"), sign_words(F.col(vec_col), bits).alias("code"))
    return coded.where("id IS NOT NULL AND code IS NOT NULL").distinct()


SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id,
             len(list_filter(range(1, len(q.s) + 1), lambda i: q.s[i] <> r.s[i]))::INT AS distance
      FROM e q, e r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM d)
SELECT * FROM k WHERE rank <= 10
"""
