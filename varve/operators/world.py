"""Restores of whole worlds: region files of slots, files of other channels, the old world moved aside, and waiting restores."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from varve.functions import positions
from varve.operators.collection import missing
from varve.operators.upkeep import _path
from varve.sources.codecs import write_region
from varve.sources.file_sink import write_files

# What of a world a restore replaces.
PARTS = ("region", "entities", "data", "playerdata", "stats", "advancements", "poi", "DIM-1", "DIM1", "dimensions", "level.dat", "level.dat_old")
PENDING = "pending-restore"


def region_folder(dim: Column, channel: Column) -> Column:
    """The folder of a dimension's regions or entities below the world."""
    dim_folder = positions.dimension_folder(dim)
    return F.concat(F.when(dim_folder == "", "").otherwise(F.concat(dim_folder, F.lit("/"))), F.when(channel.isin("entity", "entities"), "entities").otherwise("region"))


def region_files(slots: DataFrame) -> DataFrame:
    """(path, content) of the region files of slots (dim, channel, rx, rz, slot, payload), and of the files of external payloads.

    A region has 1024 slots at most, which is all that one group holds.  Of two payloads of one slot the greater stands.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        folder, rx, rz = group["folder"].iloc[0], int(group["rx"].iloc[0]), int(group["rz"].iloc[0])
        held = {int(s): bytes(p) for s, p in sorted(zip(group["slot"], group["payload"], strict=True))}
        data, outside = write_region(held)
        rows = [(f"{folder}/c.{rx * 32 + s % 32}.{rz * 32 + s // 32}.mcc", b) for s, b in outside.items()]
        return pd.DataFrame([*rows, (f"{folder}/r.{rx}.{rz}.mca", data)], columns=["path", "content"])

    rows = slots.where(F.col("payload").isNotNull()).select(region_folder(F.col("dim"), F.col("channel")).alias("folder"), "rx", "rz", F.col("slot").cast("int").alias("slot"), "payload")
    return rows.groupBy("folder", "rx", "rz").applyInPandas(build, "path string, content binary")


def rewrite_regions(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, content) of the regions that hold ``targets`` (dim, channel, rx, rz, slot, payload), with all other slots of theirs as they were."""
    region, key = ["dim", "channel", "rx", "rz"], ["dim", "channel", "rx", "rz", "slot"]
    touched = existing.select(*key, "payload").join(targets.select(*region).distinct(), region, "left_semi")
    new = targets.select(*key, F.col("payload").alias("new"))
    return region_files(touched.join(new, key, "full_outer").select(*key, F.coalesce("new", "payload").alias("payload")))


def snapshot_files(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, content) of all files of a snapshot's entries (channel, dim, pos, path, hash) out of objects (hash, payload)."""
    whole = entries.join(objects.select("hash", "payload"), "hash")
    x, z = positions.unpack_x(F.col("pos")), positions.unpack_z(F.col("pos"))
    cells = whole.where(F.col("channel").isin("chunk", "entity")).select(
        "dim", "channel", positions.region(x).alias("rx"), positions.region(z).alias("rz"), positions.slot(x, z).alias("slot"), "payload"
    )
    path = F.when(F.col("channel") == "savedData", positions.saved_data_target(F.col("path"))).otherwise(F.col("path"))
    plain = whole.where(F.col("channel").isin("savedData", "files", "levelDat")).select(path.alias("path"), F.col("payload").alias("content"))
    return region_files(cells).unionByName(plain)


def move_aside(spark: SparkSession, world: str, now_ms: int | None = None) -> str:
    """Move what a restore replaces to a folder beside the world and name it; if one move fails those before it are taken back."""
    backup = f"{world.rstrip('/')}.bak-{int(time.time() * 1000) if now_ms is None else now_ms}"
    moved: list[str] = []
    try:
        for part in PARTS:
            source, fs = _path(spark, f"{world.rstrip('/')}/{part}")
            if fs.exists(source):
                if not moved:
                    fs.mkdirs(_path(spark, backup)[0])
                if not fs.rename(source, _path(spark, f"{backup}/{part}")[0]):
                    raise OSError(f"{part} could not be moved")
                moved.append(part)
    except BaseException:
        for part in reversed(moved):
            _path(spark, world)[1].rename(_path(spark, f"{backup}/{part}")[0], _path(spark, f"{world.rstrip('/')}/{part}")[0])
        raise
    return backup


def restore_world(spark: SparkSession, headers: DataFrame, entries: DataFrame, objects: DataFrame, snapshot_id: str, world: str, now_ms: int | None = None) -> Row:
    """Rebuild a world of a snapshot; what it gives are the counts of each channel and where the old world went.

    In this order: the snapshot has to be there and its baseline complete, every object it references has to be in the
    store, and only then is the old world moved aside and the new one written.
    """
    found = headers.where(F.col("snapshot_id") == snapshot_id).select("baseline_complete").take(1)
    if not found:
        raise FileNotFoundError(f"no snapshot {snapshot_id}")
    if not found[0].baseline_complete:
        raise ValueError(f"snapshot {snapshot_id} has no complete baseline; a restore would lose what was never captured")
    mine = entries.where(F.col("snapshot_id") == snapshot_id)
    lost = missing(mine, objects).take(5)
    if lost:
        raise ValueError(f"objects of snapshot {snapshot_id} are missing: {', '.join(r.hash for r in lost)}")
    backup = move_aside(spark, world, now_ms)
    write_files(snapshot_files(mine, objects), world)
    return counts(mine).withColumn("backup", F.lit(backup)).first()


def counts(entries: DataFrame) -> DataFrame:
    """What a restore of some entries writes: cells of both kinds, files of both kinds, suspect ones, and whether there is a level file."""
    n = lambda name: F.count_if(F.col("channel") == name)
    return entries.agg(
        n("chunk").alias("chunks"), n("entity").alias("entities"), n("savedData").alias("saved_data"), n("files").alias("files"),
        F.count_if((F.col("channel") == "files") & F.coalesce("suspect", F.lit(False))).alias("suspect"), (n("levelDat") > 0).alias("level"),
    )


def set_pending(spark: SparkSession, world: str, snapshot_id: str) -> None:
    """Ask for a restore at the next start."""
    flag, fs = _path(spark, f"{world.rstrip('/')}/{PENDING}")
    out = fs.create(flag, True)
    out.write(bytearray(snapshot_id.encode()))
    out.close()


def pending(spark: SparkSession, world: str) -> str | None:
    """The snapshot that a waiting restore names; none if there is no flag or it is empty."""
    flag, fs = _path(spark, f"{world.rstrip('/')}/{PENDING}")
    if not fs.exists(flag):
        return None
    text = "\n".join(r.value for r in spark.read.text(flag.toString()).collect()).strip()
    return text or None


def run_pending(spark: SparkSession, world: str, restore: Callable[[str], Row]) -> Row | None:
    """Run a waiting restore; its flag goes only after it has succeeded, so that a failed one is tried again."""
    snapshot_id = pending(spark, world)
    if snapshot_id is None:
        return None
    result = restore(snapshot_id)
    flag, fs = _path(spark, f"{world.rstrip('/')}/{PENDING}")
    fs.delete(flag, False)
    return result
