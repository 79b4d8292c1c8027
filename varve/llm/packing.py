"""Vector best-fit-decreasing packing of token documents into sequences.

A document's ids and an end id are cut into pieces of at most ``capacity`` ids
(all but the first are full).  A piece of n ids asks of a bin n tokens, one
document and n * n of attention cost; a bin has a capacity of each.  Pieces go in
order of falling length, each to the open bin that fits under *every* constraint
and has the least weighted residual norm afterwards, or the greatest weighted
dot-product of demand and residual (``rule``); if none fits, to a new bin.

Pieces of one length are alike, and so are bins with the same residual vector.  The
whole packing therefore follows from the number of pieces of each length: at most
``capacity`` numbers go to the driver, whatever the corpus, and come back as a
*recipe* that says where the pieces ranked i to j of a length go.  A residual that
cannot bind any more (room for more documents than tokens, more attention cost than
one piece of all tokens) counts as just enough, which bounds the different bins.  The
ranks come from counts for each file partition and length; texts are never shuffled
and pieces once, as rows of numbers.

Defined results: a null or empty text is one piece with only the end id; null
doc_ids and repeated rows are packed like others; ties in length go by file
partition and position; an empty table gives an empty result; other columns
are ignored.  Very long texts are cut, never dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm._shared import stash
from varve.llm.tokenizing import Encoder, slices


@dataclass(frozen=True)
class Packing:
    """Capacities of a sequence, and how a bin is chosen."""

    capacity: int = 2048
    max_docs: int | None = None
    max_attention: int | None = None
    rule: str = "residual_norm"
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)

    def __post_init__(self):
        if self.rule not in ("residual_norm", "dot_product"):
            raise ValueError(f"rule must be residual_norm or dot_product, not {self.rule!r}")
        if self.max_attention is not None and self.max_attention < 1:
            raise ValueError("a piece of one id must fit")

    @property
    def capacities(self) -> tuple[int, int, int]:
        c = self.capacity
        return c, self.max_docs or c, self.max_attention or c * c

    @property
    def piece(self) -> int:
        """The longest piece that fits into an empty bin under every constraint."""
        return min(self.capacity, int(self.capacities[2] ** 0.5))


def recipe(counts: dict[int, int], packing: Packing) -> dict[str, np.ndarray]:
    """Where pieces go, as columns ordered by (length, first).

    The pieces of ``length`` ranked first, first + 1, ... go to bins ``bin``,
    ``bin`` + 1, ..., ``each`` of them to every bin from ``offset`` on, until
    the next row of the length begins.
    """
    caps = packing.capacities
    unit = np.array([w / c for w, c in zip(packing.weights, caps, strict=True)])
    rows: list[tuple[int, int, int, int, int]] = []
    state = np.zeros((0, 3))  # residuals of the different open bins
    bins: list[list[tuple[int, int]]] = []  # for each of them, its bins as (first, number)
    n_bins = 0

    def settle(tokens: int, docs: int, attention: int) -> tuple[int, int, int]:
        return tokens, min(docs, tokens), min(attention, tokens * tokens)

    def put(residual: tuple[int, int, int], first: int, number: int) -> None:
        nonlocal state
        residual = settle(*residual)
        if min(residual) == 0:
            return
        at = np.flatnonzero((state == residual).all(1))
        if len(at):
            bins[at[0]].append((first, number))
        else:
            state = np.vstack([state, residual])
            bins.append([(first, number)])

    for length in sorted(counts, reverse=True):
        asked, left, rank = np.array([length, 1, length * length]), counts[length], 0
        while left:
            fits = np.flatnonzero((state >= asked).all(1)) if len(state) else np.zeros(0, int)
            if len(fits):
                r = state[fits]
                score = np.linalg.norm((r - asked) * unit, axis=1) if packing.rule == "residual_norm" else -((r * unit) @ (asked * unit))
                k = int(fits[np.argmin(score)])
                residual, (first, number) = tuple(int(x) for x in state[k]), bins[k].pop()
                if not bins[k]:
                    state = np.delete(state, k, 0)
                    del bins[k]
            else:
                residual, first, number = settle(*caps), n_bins, left
            fresh = first == n_bins
            # After a piece, its bin has the least residual of those that were alike, so it stays the choice while it fits.
            each = 1 if packing.rule == "dot_product" else min(residual[0] // length, residual[1], residual[2] // (length * length))
            full = min(number, left // each)
            offset = caps[0] - residual[0]
            after = lambda n, r=residual: (r[0] - n * length, r[1] - n, r[2] - n * length * length)
            if full:
                rows.append((length, rank, first, each, offset))
                put(after(each), first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and full < number:  # fewer than ``each`` are left: the last bin of this length
                rows.append((length, rank, first + full, left, offset))
                put(after(left), first + full, 1)
                used, rank, left = full + 1, rank + left, 0
            if fresh:
                n_bins += used
            elif used < number:
                put(residual, first + used, number - used)
    columns = np.array(sorted(rows), "i8").reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "each", "offset"), columns.T, strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, packing: Packing, end_id: int = 0) -> DataFrame:
    """``docs`` (doc_id, text) to rows (part, doc_id, piece, start, length, ids_crc32, local_rank).

    ``local_rank`` numbers the pieces of a length within the partition that cut them.
    """
    size = packing.piece

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, "i8")
        for whole in batches:
            for batch in slices(whole, 1):
                ids, counts = encoder.flat_ended(batch.column(1), end_id)
                ends = np.cumsum(counts)
                rows: list[tuple] = []
                for doc_id, at, n in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), counts.tolist(), strict=True):
                    begin, stop = 0, n % size or size
                    for piece in range(-(-n // size)):
                        length = stop - begin
                        rows.append((part, doc_id, piece, begin, length, zlib.crc32(ids[at + begin : at + stop]), int(seen[length])))
                        seen[length] += 1
                        begin, stop = stop, stop + size
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select("doc_id", "text").mapInArrow(cut, "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long")


def pack(docs: DataFrame, tokenizer: str, packing: Packing = Packing(), end_id: int = 0) -> DataFrame:
    """Place every piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces, _ = stash(cut_pieces(docs, tokenizer, packing, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = recipe(by_length, packing)
    before = counts.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        where = r["length"] * (1 << 42) + r["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(where, length * (1 << 42) + rank, side="right") - 1
            step = rank - r["first"][k]
            sequence, offset = r["bin"][k] + step // r["each"][k], r["offset"][k] + step % r["each"][k] * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
