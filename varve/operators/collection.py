"""Garbage collection: live and dead objects, compaction, the size guard and the automatic trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators.store import frame


def live_set(refs: DataFrame, *protect: DataFrame) -> DataFrame:
    """The hashes that snapshots reference or that are protected."""
    out = refs.select("hash")
    for more in protect:
        out = out.union(more.select("hash"))
    return out.distinct()


def missing(refs: DataFrame, objects: DataFrame) -> DataFrame:
    return refs.select("hash").distinct().join(objects.select("hash"), "hash", "left_anti")


def dead(objects: DataFrame, live: DataFrame) -> DataFrame:
    return objects.join(live, "hash", "left_anti")


def marked(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Objects with ``is_live``."""
    return objects.join(live.select("hash", F.lit(True).alias("l")), "hash", "left").withColumn("is_live", F.col("l").isNotNull()).drop("l")


def totals(objects: DataFrame, live: DataFrame) -> DataFrame:
    m = marked(objects, live)
    return m.agg(
        F.count("*").alias("scanned"),
        F.count_if("is_live").alias("retained"),
        F.count_if(~F.col("is_live")).alias("deleted"),
        F.coalesce(F.sum(F.when(~F.col("is_live"), F.col("length"))), F.lit(0)).alias("bytes_freed"),
    )


def per_pack(objects: DataFrame, live: DataFrame, hash_bytes: int = 16) -> DataFrame:
    size = F.col("length") + frame(hash_bytes)
    m = marked(objects, live)
    part = lambda keep, x: F.coalesce(F.sum(F.when(keep, x)), F.lit(0)).cast("long")
    return m.groupBy("pack_id").agg(
        F.count_if("is_live").alias("live"),
        F.count_if(~F.col("is_live")).alias("dead"),
        part(F.col("is_live"), size).alias("live_bytes"),
        part(~F.col("is_live"), size).alias("dead_bytes"),
    )


def compaction(packs: DataFrame, threshold: float, active: Column) -> DataFrame:
    """What to do with each pack; one is rewritten if its dead share passes the threshold."""
    total = F.col("live_bytes") + F.col("dead_bytes")
    action = (
        F.when(total == 0, "skip")
        .when(active, "skip")
        .when(F.col("live") == 0, "delete")
        .when(F.col("dead_bytes") / total <= threshold, "skip")
        .otherwise("rewrite")
    )
    return packs.withColumn("action", action)


def size_guard(objects: DataFrame, refs: DataFrame, headers: DataFrame, doomed: DataFrame, max_bytes: int, threshold: float = 0.5, hash_bytes: int = 16, protect: DataFrame | None = None) -> DataFrame:
    """What a store past its limit frees: (before, triggered, pruned, bytes_freed, after, still_over).

    Up to the limit nothing happens.  Past it the ``doomed`` snapshots go first, so that what only they
    reference is dead; then packs are collected: those without a live object go whole, those whose dead share
    passes ``threshold`` are rewritten, others keep their dead.
    """
    if max_bytes <= 0:
        raise ValueError("the limit must be positive")
    left = refs.join(doomed.select("snapshot_id"), "snapshot_id", "left_anti")
    packs = compaction(per_pack(objects, live_set(left, *([] if protect is None else [protect])), hash_bytes), threshold, F.lit(False))
    freed = F.when(F.col("action").isin("delete", "rewrite"), F.col("dead_bytes")).otherwise(0)
    sizes = packs.agg(F.coalesce(F.sum(F.col("live_bytes") + F.col("dead_bytes")), F.lit(0)).alias("before"), F.coalesce(F.sum(freed), F.lit(0)).alias("freed"))
    gone = headers.select("snapshot_id").join(doomed.select("snapshot_id"), "snapshot_id", "left_semi").agg(F.count("*").alias("n"))
    over = F.col("before") > max_bytes
    when = lambda x: F.when(over, x).otherwise(0).cast("long")
    after = F.col("before") - when(F.col("freed"))
    return sizes.crossJoin(gone).select(  # one row each
        "before", over.alias("triggered"), when(F.col("n")).alias("pruned"), when(F.col("freed")).alias("bytes_freed"), after.alias("after"), (after > max_bytes).alias("still_over")
    )


def dead_in_window(written: DataFrame, pending: DataFrame, referenced: DataFrame) -> DataFrame:
    """Objects of a window that neither a pending change nor the new snapshot needs."""
    return written.select("hash").distinct().join(pending.select("hash"), "hash", "left_anti").join(referenced.select("hash"), "hash", "left_anti")


def triggers(windows: DataFrame, order: str, dead_count: str, limit: int) -> DataFrame:
    """Dead objects summed over windows; at ``limit`` a collection runs and the sum begins anew.

    A fold over one pair of numbers a snapshot: they pass through one task in order, of which only the sum is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in batches:
            sums = []
            for n in b["n"].tolist():
                total = (0 if total >= limit else total) + n
                sums.append(total)
            yield pd.DataFrame({order: b[order], "accumulated": pd.Series(sums, dtype="int64"), "collects": [x >= limit for x in sums]})

    kind = windows.schema[order].dataType.simpleString()
    rows = windows.select(F.col(order), F.col(dead_count).cast("long").alias("n")).repartition(1).sortWithinPartitions(order)
    return rows.mapInPandas(fold, f"{order} {kind}, accumulated long, collects boolean")
