"""Verification of snapshots and objects, and the rebuilt index of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(headers: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Each snapshot's status and its missing objects: OK, INCOMPLETE or CORRUPT (unreadable header)."""
    lost = refs.select("snapshot_id", "hash").distinct().join(objects.select("hash"), "hash", "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("n"))
    status = F.when(~F.col("readable"), "CORRUPT").when(F.col("n") > 0, "INCOMPLETE").otherwise("OK")
    joined = headers.join(lost, "snapshot_id", "left")
    return joined.select("snapshot_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("missing"))


def classify(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """fsck: the class of each object.  Objects have ``hash``, ``rehash``, ``inflates``; refs ``hash``, ``kind``.

    In this order: mismatch; orphan (no failure); corrupt chunk; ok chunk; ok file.
    An object that any reference takes for a chunk is one.
    """
    kinds = refs.groupBy("hash").agg(F.bool_or(F.col("kind") == "chunk").alias("chunk"))
    cls = (
        F.when(F.col("hash") != F.col("rehash"), "mismatch")
        .when(F.col("chunk").isNull(), "orphan")
        .when(F.col("chunk") & ~F.col("inflates"), "corrupt")
        .when(F.col("chunk"), "chunk")
        .otherwise("file")
    )
    return objects.join(kinds, "hash", "left").select("hash", cls.alias("class"))


def counters(classes: DataFrame) -> DataFrame:
    count = lambda *names: F.count_if(F.col("class").isin(*names))
    return classes.agg(
        F.count("*").alias("scanned"),
        count("chunk", "file").alias("ok"),
        count("chunk").alias("chunks"),
        count("file").alias("files"),
        count("mismatch").alias("mismatches"),
        count("corrupt").alias("corrupts"),
        count("orphan").alias("orphans"),
    )


def index_lines(snapshots: DataFrame) -> DataFrame:
    """One line a snapshot: id, status, created, chunks, entities, files, missing."""
    columns = ["snapshot_id", "status", "created_ms", "chunks", "entities", "files", "missing"]
    return snapshots.select("snapshot_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("line"))
