r"""SimHash near-duplicates by pigeonhole blocks.

A text's letters A-Z are lower-cased, its words are ``[^\x20\x09-\x0D]+``, and each of
its ``shingle``-word sequences, repeats included and joined by single spaces, is hashed
by XXH64 (seed 42; a text of fewer words is one sequence).  A bit of the fingerprint is
1 if it is set in more than half the hashes; a text without words has fingerprint 0.

Two fingerprints that differ in at most ``distance`` bits agree on at least
n - ``distance`` of n blocks.  Each different fingerprint is dealt out
once for every choice of so many blocks, keyed by their bits; equal keys meet in a
task, which checks Hamming distances.  Copies share a fingerprint and meet nobody.
Every n finds every pair; ``blocks_for`` takes the one that costs least for the number of different
fingerprints, as more blocks make longer keys, which fewer share by chance, but more of them.
At a distance of 4, 6 blocks are 15 keys of 21 bits, 7 are 35 of 27 and 8 are 70 of 32; 6 are taken up to 1.5 * 10^9
fingerprints and 7 up to 9 * 10^10.  Of 3 * 10^10 a key then holds 170 by chance, where with 6 blocks it would hold 11,000.
Within a key, links become a forest: what is already connected is not compared
again, and dense groups give as many edges as they have members.  A key with more than
``CHUNK`` fingerprints is dealt as pairs of chunks to different tasks, so every pair
still meets.  Documents are linked to their fingerprints' components; a component is
named by its smallest doc_id.

Defined results: null and empty texts have fingerprint 0 and link like others; null
doc_ids name no component unless nothing else is in it; repeated rows are in one
component and ``deduplicate`` keeps one of them; an empty table gives an empty result;
columns other than doc_id and text are carried by ``deduplicate`` and ignored else.
Texts are hashed whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm._shared import stash
from varve.llm.components import components

#: What it costs to deal out a key, in comparisons of two fingerprints.
DEALING = 400
SEED = 42
CHUNK = 16_384
#: Runs up to this length are compared all at once.
SHORT = 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    words = data.split()  # at the six white-space bytes
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    ends = (starts[min(shingle, len(words)) :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)], "<u8")
    ones = np.unpackbits(hashes.view("u1").reshape(n, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def blocks_for(fingerprints: int, distance: int) -> int:
    """The number of blocks with which finding all pairs among so many different fingerprints costs least."""

    def cost(blocks: int) -> float:
        bits = 64 * (blocks - distance) / blocks
        return comb(blocks, distance) * (DEALING + fingerprints / 2**bits)

    return min(range(distance + 2, distance + 7), key=cost)  # one block alone is too often the same in like texts


def _masks(distance: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks on which close fingerprints can agree."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """The groups of two and more that are linked among ``fps`` (different, unsigned)."""
    while len(fps):
        group, fps = [fps[:1]], fps[1:]
        todo = [int(group[0][0])]
        while todo and len(fps):
            near = np.bitwise_count(fps ^ np.uint64(todo.pop())) <= distance
            if near.any():
                group.append(fps[near])
                todo += fps[near].tolist()
                fps = fps[~near]
        if len(group) > 1:
            yield np.concatenate(group)


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp) that connect whatever links within ``distance`` connect."""
    if not 0 <= distance <= 8:
        raise ValueError("distance must be 0 to 8")
    if blocks is not None and blocks <= distance:
        raise ValueError("there must be more blocks than bits that may differ")
    blocks = blocks or blocks_for(fps.count(), distance)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(distance, blocks))])
    dealt = fps.select("fp", F.explode(keys).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot, _ = stash(sizes.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "hot-keys")
    mine = F.pmod(F.xxhash64("fp"), "chunks").cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda other: F.least(mine, other) * F.col("chunks") + F.greatest(mine, other))
    )
    runs = dealt.join(hot, "key", "left").select("key", "fp", F.explode(pairs).alias("pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] = ()
        for b in batches:
            now = tuple(b.column(k).to_numpy() for k in range(3))
            whole = tuple(np.concatenate(x) for x in zip(kept, now, strict=True)) if kept else now
            key, pair, _ = whole
            last = int(np.flatnonzero((key == key[-1]) & (pair == pair[-1]))[0]) if len(key) else 0
            kept = tuple(x[last:] for x in whole)
            yield from out(tuple(x[:last] for x in whole))
        if kept:
            yield from out(kept)

    def out(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, pair, fp = rows
        if not len(key):
            return
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
        sizes = np.diff(np.append(begins, len(key)))
        unsigned = fp.view("u8")
        a, b = [], []
        # Short runs: every row is compared with that ``lag`` rows further on, for all runs at once.
        size_of, left_of = np.repeat(sizes, sizes), np.repeat(begins + sizes, sizes) - np.arange(len(key))
        short = size_of <= SHORT
        for lag in range(1, min(SHORT, int(sizes.max()))):
            at = np.flatnonzero(short & (left_of > lag))
            at = at[np.bitwise_count(unsigned[at] ^ unsigned[at + lag]) <= distance]
            a.append(fp[at])
            b.append(fp[at + lag])
        for begin, size in zip(begins[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            for group in _forest(unsigned[begin : begin + size], distance):
                group = group.view("i8")
                a.append(group[1:])
                b.append(group[(np.arange(1, len(group)) - 1) // 8])  # a tree of small degree
        a, b = np.concatenate(a or [np.zeros(0, "i8")]), np.concatenate(b or [np.zeros(0, "i8")])
        keep = _spanning(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return runs.select("key", "pair", "fp").repartition("key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(run, "a long, b long")


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges connect what the edges before them do not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(k)
    return keep


def cluster(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) of every row; rows of a component share both last columns."""
    rows, _ = stash(fingerprints(docs, shingle), "fingerprints")
    different, _ = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "different-fingerprints")
    edges = links(different, distance)
    # xxhash64 of a long is a bijection: fingerprints get random numbers, and no two the same.
    label = components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    # Tables are written before they are joined by label: Spark splits the hot keys of a join only if it deals out both sides for it.
    named, _ = stash(different.withColumn("node", F.xxhash64("fp")).join(label, "node", "left").select("fp", "first", F.coalesce("label", "node").alias("label")), "labels")
    least, _ = stash(named.groupBy("label").agg(F.min("first").alias("component_id")), "component-names")
    of_fp, _ = stash(named.join(least, "label").select("fp", "label", "component_id"), "components")
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "label", "component_id")


def deduplicate(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest doc_id, then the smallest text hash."""
    found, _ = stash(cluster(docs, distance, shingle), "clusters")
    kept = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select("label", F.col("kept.doc_id").alias("keep_id"), F.col("kept.text_hash").alias("keep_hash"))
    kept, _ = stash(kept, "kept")
    # How many rows are the kept one, so that only of repeated rows all but one have to go.
    same = found.join(kept, "label").where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")))
    first = same.groupBy("keep_id", "keep_hash").agg(F.count("*").alias("times"))
    # The rows travel inside a struct, so that none of their names can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"))
    stay = rows.join(first, rows["own_id"].eqNullSafe(first["keep_id"]) & (rows["own_hash"] == first["keep_hash"]))
    once, more = stay.where("times = 1"), stay.where("times > 1").dropDuplicates(["keep_id", "keep_hash"])
    return once.select("row").unionByName(more.select("row")).select("row.*")
