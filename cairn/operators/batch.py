"""Batches of items: outcomes, destinations and progress."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.parsing import exit_code
from cairn.functions.paths import suffix
from cairn.operators.layout import running_total

STATUSES = ("Completed", "Failed", "Skipped", "Cancelled")


def outcome_counts(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Items by outcome; whatever is neither completed nor skipped has failed."""
    done, skipped = F.col("status") == "Completed", F.col("status") == "Skipped"
    return items.groupBy(*within).agg(
        F.count_if(done).alias("succeeded"),
        F.count_if(~done & ~skipped).alias("failed"),
        F.count_if(skipped).alias("skipped"),
    )


def roll_up(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """State of a batch: Completed if all items are (or there is none), then Cancelled, Failed, Partial."""
    state = (
        F.when(F.count_if(F.col("status") != "Completed") == 0, "Completed")
        .when(F.count_if(F.col("status") == "Cancelled") > 0, "Cancelled")
        .when(F.count_if(F.col("status") == "Failed") > 0, "Failed")
        .otherwise("Partial")
    )
    return items.groupBy(*within).agg(state.alias("state"))


def _refused(prefix: str) -> Column:
    open_ = ~F.col("status").isin("Completed", "Skipped")
    return F.count_if(open_ & F.coalesce(F.startswith("error", F.lit(prefix)), F.lit(False)))


def refusals(items: DataFrame, prefix: str, within: tuple[str, ...] = ()) -> DataFrame:
    """How many items were refused: neither completed nor skipped, with a message that begins so."""
    return items.groupBy(*within).agg(_refused(prefix).alias("refused"))


def exit_codes(items: DataFrame, prefix: str, within: tuple[str, ...] = ()) -> DataFrame:
    """A batch's exit code: ok if no item failed, refused if all that failed were refusals."""
    failed = F.count_if(~F.col("status").isin("Completed", "Skipped"))
    outcome = F.when(failed == 0, "ok").when(failed == _refused(prefix), "refused").otherwise("pack_failed")
    return items.groupBy(*within).agg(exit_code(outcome).alias("exit_code"))


def concatenated(*results: DataFrame) -> DataFrame:
    """The result rows of several batches; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def claimed(items: DataFrame, wanted: Column, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``destination`` of each item, in ``order``: the wanted one if no item before it has it, whatever
    its case, else the first of ``_1``, ``_2``, ... that none has. ``taken(path)`` are not free at all."""
    return _named(items, wanted, F.lit(""), order, True, taken, "destination")


def free_names(items: DataFrame, path: Column, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``free``: a path that an item before it has, or that is in ``taken(path)``, gets the first ``_n``
    before its extension that makes it free."""
    return _named(items, path, suffix(path), order, False, taken, "free")


def _named(
    items: DataFrame, wanted: Column, ext: Column, order: str, fold: bool, taken: DataFrame | None, out: str
) -> DataFrame:
    """Names of items, none twice.

    Where a name is wanted by several, the n-th has its number, counted over ranges so that a name
    wanted by very many is spread. That is all unless a name with a number is itself wanted, or taken:
    what then is free depends on all names of that family (the same but for numbers at the end) before,
    so only such families are gone through item by item, each in one task. ``order`` must tell items
    apart; where it is null an item comes first.
    """
    key = lambda c: F.lower(c) if fold else c

    def parted(rows: DataFrame, name: Column, end: Column) -> DataFrame:
        rows = rows.withColumns({"__w": name, "__e": end})
        rows = rows.withColumn("__s", F.left("__w", F.char_length("__w") - F.char_length("__e")))
        family = F.concat(F.regexp_replace("__s", "(_[0-9]+)+$", ""), F.lit("\x00"), "__e")
        return rows.withColumns({"__k": key(F.col("__w")), "__f": key(family)})

    rows = parted(items, wanted, ext)
    there = items.sparkSession.createDataFrame([], "path string") if taken is None else taken.select("path").distinct()
    there = parted(there, F.col("path"), F.lit("") if fold else suffix(F.col("path"))).drop("path")
    parts = ["__w", "__s", "__e", "__k", "__f"]
    names = (
        rows.select(*parts)
        .unionByName(there)
        .groupBy("__k", "__f")
        .agg(F.count("*").alias("m"), F.first(key(F.col("__s"))).alias("s"), F.first(key(F.col("__e"))).alias("e"))
    )
    number = F.regexp_extract("s", "_([1-9][0-9]{0,17})$", 1)
    basis = F.concat(F.regexp_replace("s", "_[0-9]+$", ""), "e")
    kids = names.where(number != "").groupBy(basis.alias("__k")).agg(F.min(number.cast("bigint")).alias("n"), F.count("*").alias("kids"))
    mixed = names.join(kids, "__k").where("n <= m - 1 + kids").select("__f").distinct()
    columns = [c for c in items.columns if c != out]
    simple = rows.join(mixed, "__f", "left_anti").join(
        there.groupBy("__k").agg(F.count("*").alias("__taken")), "__k", "left"
    )
    counted = running_total(simple, order, F.lit(1), "__before", ("__k",))
    n = F.col("__before") + F.least(F.coalesce("__taken", F.lit(0)), F.lit(1))
    name = F.when(n == 0, F.col("__w")).otherwise(F.concat("__s", F.lit("_"), n, "__e"))
    easy = counted.select(*columns, name.alias(out))

    def settle(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        fold_ = str.lower if fold else str
        has, found, last = set(map(fold_, held["__w"])), [], {}
        group = group.sort_values(order, kind="stable")
        for w, s, e in zip(group["__w"], group["__s"], group["__e"]):
            choice, at = w, last.get(fold_(w), 0)
            if at:
                choice = f"{s}_{at}{e}"
            while fold_(choice) in has:
                at += 1
                choice = f"{s}_{at}{e}"
            last[fold_(w)] = at
            has.add(fold_(choice))
            found.append(choice)
        group[out] = found
        return group[[*columns, out]]

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name != out]
    hard = rows.join(mixed, "__f").select(*columns, "__w", "__s", "__e", "__f").groupBy("__f")
    held = there.join(mixed, "__f", "left_semi").select("__w", "__f").groupBy("__f")
    return easy.unionByName(hard.cogroup(held).applyInPandas(settle, ", ".join([*kinds, f"`{out}` string"])))


def missing(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not exist yet."""
    return wanted.join(existing.select(key), key, "left_anti")


def present(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists."""
    return wanted.join(existing.select(key), key, "left_semi")


def batch_progress(events: DataFrame, batch: str, order: str, n_items: Column, local: Column) -> DataFrame:
    """A batch's share as items report theirs: items that ended before, and this one's, over all."""
    before = W.partitionBy(batch).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0))
    share = F.least((ended + F.least(F.greatest(local, F.lit(0.0)), F.lit(1.0))) / n_items, F.lit(1.0))
    return events.withColumn("batch_ratio", share)
