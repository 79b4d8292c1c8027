"""Restores: all of a snapshot, single cells, areas; and the layout of rebuilt regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import positions

SECTOR, FIRST_SECTOR, MAX_SECTORS = 4096, 2, 255


def gate(headers: DataFrame, snapshot_id: str) -> DataFrame:
    """The header of a full restore; an error unless its baseline is complete."""
    ok = F.when(F.col("baseline_complete"), True).otherwise(F.raise_error(F.lit("the snapshot has no complete baseline")))
    return headers.where(F.col("snapshot_id") == snapshot_id).withColumn("allowed", ok)


def area_targets(centres: DataFrame, radius: int) -> DataFrame:
    """(dim, x, z, pos) of the cells around each centre (dim, x, z)."""
    xs, zs = positions.area(F.col("x"), F.col("z"), radius)
    return centres.select("dim", "z", xs.alias("cx")).select("dim", "cx", zs.alias("cz")).select("dim", F.col("cx").alias("x"), F.col("cz").alias("z"), positions.pack(F.col("cx"), F.col("cz")).alias("pos"))


def resolve(targets: DataFrame, manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """Targets with hash and outcome: restored, not captured, or object missing.

    The manifest is read once for all targets and a failing target fails alone.
    """
    found = targets.join(manifest.select("dim", "pos", "hash"), ["dim", "pos"], "left")
    have = objects.select("hash", F.lit(True).alias("have"))
    outcome = F.when(F.col("hash").isNull(), "not_captured").when(F.col("have").isNull(), "object_missing").otherwise("restored")
    return found.join(have, "hash", "left").withColumn("outcome", outcome).drop("have")


def restore_partial(targets: DataFrame, manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """As ``resolve``; a target that was asked for explicitly and not captured is an error, in an area it is skipped."""
    out = resolve(targets, manifest, objects)
    wrong = F.col("explicit") & (F.col("outcome") == "not_captured")
    return out.withColumn("outcome", F.when(wrong, F.raise_error(F.lit("a requested cell was never captured"))).otherwise(F.col("outcome")))


def message(outcome):
    """A sentence for an outcome."""
    return (
        F.when(outcome == "restored", "restored").when(outcome == "not_captured", "not in this snapshot").when(outcome == "object_missing", "its object is missing from the store").otherwise("failed")
    )


def region_layout(payloads: DataFrame) -> DataFrame:
    """Sectors of rebuilt regions: (dim, rx, rz, slot, length) with first sector, sectors, external.

    Slots go in order, from the third sector on; what needs more than 255 sectors goes to a
    file of its own and leaves a stub of one.  A region has at most 1024 slots.
    """
    need = F.ceil((F.col("length") + 5) / SECTOR)
    sized = payloads.withColumn("external", need > MAX_SECTORS).withColumn("sectors", F.when(need > MAX_SECTORS, 1).otherwise(need).cast("long"))
    w = Window.partitionBy("dim", "rx", "rz").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("first_sector", F.coalesce(F.sum("sectors").over(w), F.lit(0)) + FIRST_SECTOR)


def replace_slots(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """A region's slots with some replaced and all others as they were (slot, payload)."""
    t = targets.select("dim", "rx", "rz", "slot", F.col("payload").alias("new"))
    return existing.join(t, ["dim", "rx", "rz", "slot"], "full_outer").select("dim", "rx", "rz", "slot", F.coalesce("new", "payload").alias("payload"))
