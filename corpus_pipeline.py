"""From raw documents to packed sequences, stage by stage.

Each stage takes all that the one before kept, as Parquet, and its decisions take
effect: rejected documents go, one document of each near-duplicate group stays,
repeated passages and benchmark passages are cut out of the texts, and what is left is
packed.  All stages but the last return the columns of ``documents``.

Defined results: null, empty and other texts that the base counts reject go in the first stage, repeated rows become one
in the second, and a document of which nothing is left is packed as its end id; columns beyond those of ``documents`` are
carried up to the last stage, whatever their names; an empty table gives an empty result.  What a stage has read is deleted from
the shared folder once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varve.llm import decontaminate, packing, quality, simhash, suffix_dedup
from varve.llm._shared import discard, scratch, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and are near their language's histograms."""
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at 4 or fewer bits."""
    return simhash.deduplicate(docs, distance=4, shingle=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that stand anywhere else as well."""
    # A passage is sought by strings of 160 bytes: in all languages of the corpus over 99.9 % of 51 words in a row are as long.
    return suffix_dedup.remove(docs, suffix_dedup.Sizes(160), least_words=51)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 10-word windows of benchmark items."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), packing.Packing(capacity=2048))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, path = stash(stage(spark, docs, sf_dir), name)
            keep(path)
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
