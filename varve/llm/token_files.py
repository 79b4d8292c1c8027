"""Token ids as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded, and written as
one row a document: ``doc_id, part, place, local_start, n_tokens, tokens``.
``tokens`` is list<int32> with its encoding chosen (``dictionary`` or ``delta``),
row groups and pages are of set sizes, and the writer adds page indexes, so that a
reader that asks for a few documents or for the metadata columns reads only those.

A text follows its sort key through one shuffle and is encoded after it; ids,
which are larger than texts, are never shuffled.  ``local_start`` counts ids within
a file partition; ``with_starts`` adds the sums of the partitions before it.

Defined results: a null or empty text has only the end id; null doc_ids come
first; equal doc_ids are ordered by a hash of their text, and repeated rows all stay; an empty
table gives an empty file set; other columns are ignored.  Very long texts are
encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.llm._shared import stash
from varve.llm.tokenizing import Encoder, slices

SCHEMA = "doc_id long, part int, place long, local_start long, n_tokens long, tokens array<int>"


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``docs`` (doc_id, text) as rows of ``SCHEMA``, range-partitioned and sorted by doc_id."""
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = docs.select("doc_id", "text", text_hash).repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, 1):
                ids, n = encoder.flat_ended(batch.column(1), end_id)
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(ids.view("i4")))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(n), part, "i4")),
                        pa.array(np.arange(place, place + len(n))),
                        pa.array(start + ends - n),
                        pa.array(n),
                        tokens,
                    ],
                    names=["doc_id", "part", "place", "local_start", "n_tokens", "tokens"],
                )
                place, start = place + len(n), start + int(ends[-1])

    return rows.mapInArrow(encode, SCHEMA)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10
) -> None:
    """Write the token files of ``docs`` to ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    (
        encode_sorted(docs, tokenizer, end_id)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.page.row.count.limit", 1000)
        .option("parquet.writer.version", "PARQUET_2_0")  # integers without a dictionary are then packed as deltas
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Some columns of the documents from first_id to last_id; the filter reaches the row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        df = df.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.where(F.col("doc_id") <= last_id)
    return df.select(*columns) if columns else df


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before.

    One row for each file partition is summed in one task and written, so that Spark
    knows how small the table is before it plans the join.
    """
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return tokens.join(stash(before, "starts")[0], "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def crc32_of_ids(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from rows that have ``tokens`` and ``start``."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "tokens").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
