"""Small operators around a store: markers, probes, listings, clean-up, self checks and version pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_marker(line: Column) -> Column:
    """A failure marker, ``millis<TAB>reason``, as a struct; null if it is damaged."""
    parts = F.split(line, "\t", 2)
    at = F.get(parts, 0).try_cast("long")
    return F.when(at.isNotNull(), F.struct(at.alias("at_ms"), F.coalesce(F.get(parts, 1), F.lit("")).alias("reason")))


def parse_degraded(line: Column) -> Column:
    """The time from which a degraded session is blind; null if the marker is damaged or empty, which must not be taken for time 0."""
    return F.trim(F.regexp_replace(line, r"[\r\n\t]", " ")).try_cast("long")


def parse_pending(line: Column) -> Column:
    """The snapshot that a waiting restore names; null if the marker is empty."""
    return F.nullif(F.trim(F.regexp_replace(line, r"[\r\n\t]", " ")), F.lit(""))


def first_existing(files: DataFrame, dimensions: list[str]) -> DataFrame:
    """Of saved data (name, dim, ...) that stands in several dimensions, the row of the first of them."""
    rank = F.array_position(F.array(*map(F.lit, dimensions)), F.col("dim"))
    w = Window.partitionBy("name").orderBy("rank")
    return files.withColumn("rank", rank).where(F.col("rank") > 0).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank")


def newest(ids: DataFrame, limit: int = 20) -> tuple[DataFrame, int]:
    """The newest ids and how many more there are."""
    return ids.orderBy(F.desc("snapshot_id")).limit(limit), max(0, ids.count() - limit)


def orphans(files: DataFrame, cutoff=None) -> DataFrame:
    """Temporary files left behind: all, or those modified before a cutoff."""
    left = files.where(F.col("path").endswith(".tmp"))
    return left if cutoff is None else left.where(F.col("modified") < cutoff)


def is_nested(path: Column, parent: Column) -> Column:
    """Whether a path is another or lies below it, by whole components."""
    clean = lambda p: F.rtrim(F.regexp_replace(p, "/+", "/"), F.lit("/"))
    return (clean(path) == clean(parent)) | clean(path).startswith(F.concat(clean(parent), F.lit("/")))


def changed_only(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before it of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return values.withColumn("b", before).where(~F.col(value).eqNullSafe(F.col("b")) | F.col("b").isNull()).drop("b")


def dirty_size(pending: DataFrame) -> DataFrame:
    """Entries that wait for the next snapshot, all channels together."""
    return pending.select("channel", "dim", "pos", "path").distinct().agg(F.count("*").alias("dirty"))


def self_check(written: DataFrame, objects: DataFrame) -> DataFrame:
    """A window's new objects read again: how many are missing, and how many have another hash."""
    have = objects.select("hash", "rehash")
    return written.select("hash").distinct().join(have, "hash", "left").agg(
        F.count("*").alias("checked"), F.count_if(F.col("rehash").isNull()).alias("missing"), F.count_if(F.col("rehash") != F.col("hash")).alias("mismatches")
    )


def retries(attempts: DataFrame, limit: int = 5) -> DataFrame:
    """Captures that failed (key, attempt, ok), to be tried again: those whose last attempt failed and was not the last allowed."""
    last = attempts.groupBy("key").agg(F.max_by(F.struct("attempt", "ok"), "attempt").alias("last"))
    return last.where(~F.col("last.ok") & (F.col("last.attempt") < limit)).select("key", (F.col("last.attempt") + 1).alias("attempt"))


def backfill(changes: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Changes with those a rescan found for a blind window; the rescan's come first, so that newer ones win."""
    return rescanned.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)


def pending_hashes(*channels: DataFrame) -> DataFrame:
    """The hashes that changes of any channel wait with."""
    out = channels[0].select("hash")
    for more in channels[1:]:
        out = out.union(more.select("hash"))
    return out.where(F.col("hash").isNotNull()).distinct()


def _path(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark, pointer: str, version: str) -> None:
    """Point readers to a new version of a table.

    ``pointer`` is a folder of numbered files, of which the last counts.  The new one appears in one rename, at
    no moment is there none, and the older ones stay for a rollback.
    """
    folder, fs = _path(spark, pointer)
    fs.mkdirs(folder)
    last = max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=-1)
    fresh, _ = _path(spark, f"{pointer}/_new")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(fresh, _path(spark, f"{pointer}/{last + 1:012d}")[0]):
        raise OSError(f"version {version} could not be published at {pointer}")


def published(spark, pointer: str, back: int = 0) -> str | None:
    """The version that readers see, or one of those before it; null if there is none."""
    folder, fs = _path(spark, pointer)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []
    return spark.read.text(f"{pointer}/{names[-1 - back]}").first()[0] if len(names) > back else None
