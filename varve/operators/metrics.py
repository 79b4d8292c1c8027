"""Counters of the pipeline and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def worker_counters(attempts: DataFrame) -> DataFrame:
    """Received, unique, deduped and failed per channel; each attempt is received, the first of a hash is unique, one without a hash failed.

    Attempts are counted for each hash and the counts summed; both are combined before their shuffles, so neither
    a frequent hash nor the failures of a channel are gathered anywhere.
    """
    per_hash = attempts.groupBy("channel", "hash").agg(F.count("*").alias("n"))
    failed, total = F.col("hash").isNull(), lambda x: F.coalesce(F.sum(x), F.lit(0))
    return per_hash.groupBy("channel").agg(
        F.sum("n").alias("received"),
        F.count_if(~failed).alias("unique_objects"),
        total(F.when(~failed, F.col("n") - 1)).alias("deduped"),
        total(F.when(failed, F.col("n"))).alias("failed"),
    )


def exposition(values: DataFrame, prefix: str = "varve") -> DataFrame:
    """(name, kind, help, value) as the lines of the text format, three for each metric."""
    name = F.concat_ws("_", F.lit(prefix), "name")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("help")),
        F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind")),
        F.concat(name, F.lit(" "), F.col("value").cast("string")),
    )
    return values.select(name.alias("name"), text.alias("text"))


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
