"""Rolling retention: newest n, and the newest of each of n days, ISO weeks and months; with guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.ids import checked


@dataclass(frozen=True)
class Quotas:
    hourly: int = 24
    daily: int = 7
    weekly: int = 4
    monthly: int = 12

    def __post_init__(self):
        if min(self.hourly, self.daily, self.weekly, self.monthly) < 0:
            raise ValueError("quotas are not negative")

    @property
    def off(self) -> bool:
        return not any((self.hourly, self.daily, self.weekly, self.monthly))


def flags(ids: DataFrame, quotas: Quotas) -> DataFrame:
    """Each snapshot_id with the quotas that keep it and ``keep``; an id that is none is an error.

    Ids are headers, one short row a snapshot; the windows order those alone.  With
    all quotas at 0 retention is off and everything stays.
    """
    at = checked(F.col("snapshot_id"))
    rows = ids.select("snapshot_id").distinct().select("snapshot_id", at.alias("at"))
    newest = Window.orderBy(F.desc("snapshot_id"))
    out = rows.withColumn("hourly", F.row_number().over(newest) <= quotas.hourly)
    for name, unit, n in (("daily", "day", quotas.daily), ("weekly", "week", quotas.weekly), ("monthly", "month", quotas.monthly)):
        period = F.date_trunc(unit, "at")
        of = Window.partitionBy(period).orderBy(F.desc("snapshot_id"))
        out = out.withColumn(name, (F.row_number().over(of) == 1) & (F.dense_rank().over(Window.orderBy(F.desc(period))) <= n))
    keep = F.lit(True) if quotas.off else F.col("hourly") | F.col("daily") | F.col("weekly") | F.col("monthly")
    return out.withColumn("keep", keep).drop("at")


def doomed(ids: DataFrame, quotas: Quotas) -> DataFrame:
    return flags(ids, quotas).where(~F.col("keep")).select("snapshot_id")


def protected(headers: DataFrame, pending: DataFrame) -> DataFrame:
    """Ids no pruning may touch: the latest, the latest with a baseline, and a pending restore's."""
    latest = headers.agg(F.max("snapshot_id").alias("snapshot_id"))
    baseline = headers.where("baseline_complete").agg(F.max("snapshot_id").alias("snapshot_id"))
    return latest.union(baseline).union(pending.select("snapshot_id")).where(F.col("snapshot_id").isNotNull()).distinct()


def preview(headers: DataFrame, pending: DataFrame, quotas: Quotas) -> DataFrame:
    """What pruning would do with each id: keep, delete, or guarded (doomed but protected)."""
    guard = protected(headers, pending).withColumn("guarded", F.lit(True))
    fate = F.when(F.col("keep"), "keep").when(F.col("guarded"), "guarded").otherwise("delete")
    return flags(headers, quotas).join(guard, "snapshot_id", "left").select("snapshot_id", fate.alias("fate"))


def refusal(headers: DataFrame, pending: DataFrame) -> DataFrame:
    """Why a snapshot may not be deleted by hand; null if it may."""
    marks = headers.agg(F.max("snapshot_id").alias("latest"), F.max(F.when(F.col("baseline_complete"), F.col("snapshot_id"))).alias("baseline")).first()
    waiting = pending.select("snapshot_id", F.lit(True).alias("waits"))
    why = F.when(F.col("waits"), "pending restore").when(F.col("snapshot_id") == marks["baseline"], "latest baseline").when(F.col("snapshot_id") == marks["latest"], "latest")
    return headers.join(waiting, "snapshot_id", "left").select("snapshot_id", why.alias("reason"))
