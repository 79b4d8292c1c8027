"""Snapshots: last writer wins, overlays on the previous snapshot, manifests as of many cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dim", "pos"]


def last_writer(changes: DataFrame, order: Column, *keys: str) -> DataFrame:
    """Each key's latest hash; combined before the shuffle."""
    return changes.groupBy(*(keys or KEY)).agg(F.max_by("hash", order).alias("hash"))


def versions(changes: DataFrame, *keys: str, time: str = "ts", tie: str = "seq") -> DataFrame:
    """Each change with the time from which the key's next one holds (null: it is the latest)."""
    w = Window.partitionBy(*(keys or KEY)).orderBy(time, tie)
    return changes.withColumn("until", F.lead(time).over(w))


def manifests_as_of_days(changes: DataFrame, last_day, *keys: str) -> DataFrame:
    """Entries of the manifest of every day up to ``last_day``, cut at the day's end: (day, keys, hash).

    A version is in the manifests from its own day to the day before its successor's.  Days
    are counted out of the interval, so no join of versions with cuts is made and the rows are those of
    the manifests.
    """
    v = versions(changes, *keys)
    first, stop = F.to_date("ts"), F.coalesce(F.date_sub(F.to_date("until"), 1), F.lit(last_day).cast("date"))
    return v.where(first <= stop).select(F.explode(F.sequence(first, stop)).alias("day"), *(keys or KEY), "hash")


def overlay(previous: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Inherited entries, and those of the batch over them; nothing is ever deleted."""
    keys = list(keys or KEY)
    p, b = previous.select(*keys, F.col("hash").alias("old")), batch.select(*keys, F.col("hash").alias("new"))
    status = F.when(F.col("new").isNull(), "inherited").when(F.col("old").isNull(), "added").otherwise("replaced")
    return p.join(b, keys, "full_outer").select(*keys, F.coalesce("new", "old").alias("hash"), status.alias("status"))


def diff(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keys whose hash differs between two manifests, with the kind of change."""
    keys = list(keys or KEY)
    a, b = old.select(*keys, F.col("hash").alias("old_hash")), new.select(*keys, F.col("hash").alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(*keys, "old_hash", "new_hash", kind.alias("kind"))


def byte_stats(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Bytes of each snapshot's different objects, and of those that the snapshot before it lacks: (snapshot_id, unique_bytes, delta_bytes).

    Snapshot ids, one a snapshot, are numbered in one task; references are joined on hashes.
    """
    distinct = refs.select("snapshot_id", "hash").distinct()
    order = distinct.select("snapshot_id").distinct().withColumn("after", F.lead("snapshot_id").over(Window.orderBy("snapshot_id")))
    before = distinct.join(F.broadcast(order), "snapshot_id").select(F.col("after").alias("snapshot_id"), "hash", F.lit(True).alias("had")).where(F.col("snapshot_id").isNotNull())
    held = distinct.join(before, ["snapshot_id", "hash"], "left").join(objects.select("hash", "length"), "hash")
    return held.groupBy("snapshot_id").agg(F.sum("length").alias("unique_bytes"), F.coalesce(F.sum(F.when(F.col("had").isNull(), F.col("length"))), F.lit(0)).alias("delta_bytes"))


def level_file(drained: Column, read: Column, inherited: Column) -> Column:
    """The level file's hash: of this window's change, else of the file, else of the previous snapshot."""
    return F.coalesce(drained, read, inherited)


def latch(snapshots: DataFrame, order: str, flag: str) -> DataFrame:
    """``incomplete``: whether this snapshot or any before it was degraded.

    Headers are one row a snapshot, so one ordered window over them is small.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.withColumn("incomplete", F.max(F.col(flag).cast("int")).over(w) == 1)


def last_complete(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot, latest with a baseline, and the time from which a rescan has to look."""
    return snapshots.agg(
        F.max("snapshot_id").alias("latest"),
        F.max(F.when(F.col("baseline_complete"), F.col("snapshot_id"))).alias("latest_baseline"),
        F.coalesce(F.max(F.when(~F.col("incomplete"), F.col("created_ms"))), F.lit(0)).cast("long").alias("cutoff_ms"),
    )
