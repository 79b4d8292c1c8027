"""Baseline scans: what is left to scan, progress, changed files, and merges of sorted indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["channel", "dim", "file"]


def progress(log: DataFrame) -> DataFrame:
    """Each file's status out of an append log; it never goes back, and rows without one mean scanned."""
    rank = F.when(F.col("status") == "committed", 2).otherwise(1)
    return log.groupBy(*FILE).agg(F.max(rank).alias("rank")).select(*FILE, F.when(F.col("rank") == 2, "committed").otherwise("scanned").alias("status"))


def pending(files: DataFrame, progressed: DataFrame) -> DataFrame:
    """Files still to scan: all that are not committed."""
    return files.join(progressed.where("status = 'committed'").select(*FILE), FILE, "left_anti")


def is_complete(progressed: DataFrame, finished: bool) -> DataFrame:
    return progressed.agg((F.lit(finished) & F.coalesce(F.bool_and(F.col("status") == "committed"), F.lit(False))).alias("complete"))


def promote(progressed: DataFrame, scanned_before: DataFrame) -> DataFrame:
    """Commit the files that were scanned before the drain; those scanned meanwhile wait for the next."""
    mark = scanned_before.select(*FILE, F.lit(True).alias("before"))
    status = F.when(F.col("before") & (F.col("status") == "scanned"), "committed").otherwise(F.col("status"))
    return progressed.join(mark, FILE, "left").select(*FILE, status.alias("status"))


def scan_new(slots: DataFrame, dirty: DataFrame, objects: DataFrame) -> DataFrame:
    """Scanned slots that no pending change covers, with whether the store has to take them."""
    clean = slots.join(dirty.select("channel", "dim", "pos"), ["channel", "dim", "pos"], "left_anti")
    return clean.join(objects.select("hash", F.lit(True).alias("have")), "hash", "left").withColumn("stored", F.col("have").isNull()).drop("have")


def scan_passes(read: Callable[[DataFrame], DataFrame], files: DataFrame, path: str, passes: int = 8) -> tuple[DataFrame, bool]:
    """The slots of files, read again where a read failed, and whether in the end all files were read whole.

    ``read`` turns rows of files (channel, dim, file, ...) into slots with these and ``status``; a status that begins
    with ``torn`` fails its file, of which then no slot counts.  Every pass is written below ``path``, so no file is read for it twice.
    """
    spark, left, good = files.sparkSession, files, None
    torn = F.col("status").startswith("torn")
    for k in range(passes):
        read(left).write.mode("overwrite").parquet(f"{path}/pass-{k}")
        slots = spark.read.parquet(f"{path}/pass-{k}")
        failed = slots.where(torn).select(*FILE).distinct()
        whole = slots.join(failed, FILE, "left_anti")
        good = whole if good is None else good.unionByName(whole)
        if failed.isEmpty():
            return good, True
        left = files.join(failed, FILE, "left_semi")
    return good, False


def changed_since(files: DataFrame, cutoff) -> DataFrame:
    """Files modified strictly after a cutoff (a literal, or the one value of another table: ``DataFrame.scalar()``)."""
    return files.where(F.col("modified") > cutoff)


def pack_set_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """Packs of an index against those on disk: unchanged, changed, new or gone."""
    k, f = known.select("pack_id", F.col("size").alias("was")), found.select("pack_id", F.col("size").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return k.join(f, "pack_id", "full_outer").select("pack_id", state.alias("state"))


def merge_index(base: DataFrame, delta: DataFrame, removed: DataFrame) -> DataFrame:
    """The entries of a base under those of a delta, without removed ones."""
    hidden = delta.select("hash").union(removed.select("hash"))
    return base.join(hidden, "hash", "left_anti").unionByName(delta)


def in_hash_order(index: DataFrame) -> DataFrame:
    """An index in the order of its hashes' unsigned bytes, which is that of their lower-case hex; range-partitioned, so it is written in parts that follow each other."""
    return index.orderBy("hash")
