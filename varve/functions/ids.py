"""Snapshot ids: UTC times of whole seconds, in the order of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd'T'HH-mm-ss'Z'"


def snapshot_id(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def id_time(snapshot: Column) -> Column:
    """The time of an id; null if it is none."""
    return F.try_to_timestamp(snapshot, F.lit(FORMAT))


def checked(snapshot: Column) -> Column:
    """The time of an id; an error if it is none, so that nothing is deleted by half-read lists."""
    return F.coalesce(id_time(snapshot), F.raise_error(F.concat(F.lit("not a snapshot id: "), F.coalesce(snapshot, F.lit("null")))))


def one_line(reason: Column) -> Column:
    """A text on one line, for markers."""
    return F.translate(reason, "\n\t", "  ")


def kib(n: Column) -> Column:
    return F.floor(n / 1024)


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / whole, 2)
