"""The content-addressed store: hashing, dedup, reference counts and packs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.hashing import hash_hex

#: Bytes beside the payload of a record in a pack: its hash and a length.
def frame(hash_bytes: int = 16) -> int:
    return hash_bytes + 4


def hash_objects(rows: DataFrame, payload: str, *keep: str, strategy: str = "sha256") -> DataFrame:
    """Each row's hash and length; payloads stay behind."""
    return rows.select(*keep, hash_hex(F.col(payload), strategy).alias("hash"), F.octet_length(payload).cast("long").alias("length"))


def new_objects(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """What a put would store: hashes the store lacks, once each."""
    return incoming.join(store.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def first_writers(hashed: DataFrame, order: str, *carried: str) -> DataFrame:
    """Each object with the row that stored it first: the least ``order``."""
    return hashed.groupBy("hash").agg(F.min(F.struct(order, "length", *carried)).alias("first")).select("hash", "first.*")


def reference_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("hash").agg(F.count("*").alias("refs"))


def dedup_stats(hashed: DataFrame, *keys: str) -> DataFrame:
    """Received, unique and deduped objects and bytes."""
    per_hash = hashed.groupBy(*keys, "hash").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return per_hash.groupBy(*keys).agg(
        F.sum("n").alias("received"),
        F.count("*").alias("unique_objects"),
        (F.sum("n") - F.count("*")).alias("deduped"),
        F.sum(F.col("n") * F.col("length")).alias("received_bytes"),
        F.sum("length").alias("unique_bytes"),
    )


def assign_packs(objects: DataFrame, group: str, order: Column, target: int, hash_bytes: int = 16) -> DataFrame:
    """Packs in order of arrival: a new one begins once the open one holds ``target`` bytes or more.

    The check comes before a write, so a pack may pass its target.  The rule is a fold, so
    each writer (``group``) folds its own sequence; writers' packs are independent.
    """
    size = (F.col("length") + frame(hash_bytes)).cast("long").alias("size")
    rows = objects.select(F.col(group).cast("string").alias(group), order.alias("k"), "hash", size)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, pack, used = None, 0, 0
        for batch in batches:
            packs = []
            for g, n in zip(batch[group], batch["size"].tolist(), strict=True):
                if g != writer:
                    writer, pack, used = g, 0, 0
                if used >= target:
                    pack, used = pack + 1, 0
                used += n
                packs.append(pack)
            yield pd.DataFrame({group: batch[group], "hash": batch["hash"], "pack_id": pd.Series(packs, dtype="int32"), "size": batch["size"]})

    # Rows of a writer pass through in order; only the running size is held.
    ordered = rows.repartition(group).sortWithinPartitions(group, "k", "hash")
    return ordered.mapInPandas(fold, f"{group} string, hash string, pack_id int, size long")
