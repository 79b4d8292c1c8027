r"""Benchmark decontamination by an FM-index for each shard of documents.

Letters A-Z are lower-cased; words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.  The windows of
a benchmark item are its sequences of ``window`` words; an item of fewer, but not
none, is one window.  A document word inside any occurrence of a window is hit.

A shard (``shard_bytes`` of rows, whole documents) becomes one sequence of word numbers.
Words that no item has are separators, and so are stretches shorter than the shortest
window, for no window can occur there.  The sequence is indexed: suffix array by
prefix doubling, its Burrows-Wheeler transform as a wavelet matrix, and the suffix
positions of every ``SAMPLE``-th place and of each stretch's first.  All windows are searched
backwards at once by ranks; occurrences are located by walking to sampled suffixes;
overlapping ones merge into spans.

The size of the benchmark is asked for first.  If it is one block of at most ``block_bytes``
its patterns (arrays of at most some 15 times its bytes) are broadcast, and documents are read once, without a shuffle.  A larger one is cut into
blocks by the sizes of its items (an item past the bound is a block of its own); for each the
documents are read again, one block at a time is held by the driver and by a worker, and only
the spans and items of the texts that are hit are shuffled, to be merged.  So no broadcast grows with the
benchmark, whose size the passes grow with instead.

Defined results: null texts have no words; null item_ids mark words but name no item;
repeated items and rows count as they are (an item_id is named once a document);
an empty benchmark hits nothing; an empty table gives an empty result; other columns
are carried by ``remove`` and ignored else.  Documents are searched whole, at any length.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm._shared import stash

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 24 << 20
SAMPLE = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words, lower-cased, and a space for every other.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Patterns:
    """The different windows of a block of items, as word numbers by length, and the items of each; arrays but for the words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        windows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)], "i4")
            n = min(len(ids), window)
            if n:
                mine = np.lib.stride_tricks.sliding_window_view(ids, n)
                windows.setdefault(n, []).append(mine)
                owners.setdefault(n, []).append(np.full(len(mine), number.get(name, -1)))
        #: By length: the windows, where the items of each begin, and the items (numbers of ``names``).
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(windows):
            different, which = np.unique(np.concatenate(windows.pop(n)), axis=0, return_inverse=True)
            of = np.unique(np.column_stack([which.ravel(), np.concatenate(owners.pop(n))]), axis=0)
            of = of[of[:, 1] >= 0]
            self.by_length[n] = different, np.searchsorted(of[:, 0], np.arange(len(different) + 1)), of[:, 1]


class FMIndex:
    """Backward search in a sequence of numbers, where 0 separates and is never searched."""

    def __init__(self, text: np.ndarray, size: int):
        n, gaps = len(text), text == 0
        # Each separator is a symbol of its own, less than all others, so that no suffixes are alike for long.
        rank = np.where(gaps, np.cumsum(gaps), text + int(gaps.sum()))
        step = 1
        while True:
            after = np.zeros(n, "i8")
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + n + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, "i8")
            rank[order] = new
            if new[-1] == n - 1 or step >= n:
                break
            step *= 2
        bwt = text[order - 1]  # the text ends in a separator, which comes before the first place
        starts = np.concatenate([[True], gaps[:-1]])
        sampled = starts[order] | (order % SAMPLE == 0)
        self.sampled, self.samples, self.bwt = sampled, order, bwt
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        # Wavelet matrix: on each level the numbers are parted by one bit, the highest first.
        self.levels = []
        rest = bwt
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (rest >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros_before))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        begin, end = np.zeros(len(at), "i8"), at
        for bit, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            begin = np.where(one, zeros[-1] + begin - zeros[begin], zeros[begin])
            end = np.where(one, zeros[-1] + end - zeros[end], zeros[end])
        return end - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (a row of numbers)."""
        low, high = np.zeros(len(patterns), "i8"), np.full(len(patterns), len(self.bwt), "i8")
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in some rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), "i8")
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.samples[rows] + steps


def find(texts: list[str | None], patterns: Patterns) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text of a shard: its number of words, its hit spans of words, and the items that occur."""
    words = [split_words(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype("i8")
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(len(w), [], []) for w in words]
    if not patterns.by_length:
        return out
    ids = np.zeros(int(begins[-1]), "i8")
    for w, at in zip(words, begins.tolist(), strict=False):
        ids[at : at + len(w)] = np.fromiter(map(patterns.vocabulary.get, w, repeat(0)), "i8", len(w))
    place, text = _stretches(ids, min(patterns.by_length))
    if not len(text):
        return out
    covered = np.zeros(int(begins[-1]) + 1, "i8")
    index = FMIndex(text, len(patterns.vocabulary) + 1)
    owned: list[np.ndarray] = []
    for length, (windows, first, items) in patterns.by_length.items():
        low, high = index.search(windows)
        counts = high - low
        which = np.repeat(np.arange(len(windows)), counts)
        rows = np.repeat(low, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = place[index.locate(rows)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        docs = np.searchsorted(begins, at, side="right") - 1
        pairs = np.unique(np.column_stack([docs, which]), axis=0)
        n = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
        item = items[np.arange(int(n.sum())) + np.repeat(first[pairs[:, 1]] - (np.cumsum(n) - n), n)]
        owned.append(np.column_stack([np.repeat(pairs[:, 0], n), item]))
    for doc, item in np.unique(np.concatenate(owned), axis=0).tolist():
        out[doc][2].append(patterns.names[item])
    edges = np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype("i1"), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        doc = int(np.searchsorted(begins, a, side="right")) - 1
        out[doc][1].append((a - int(begins[doc]), b - int(begins[doc])))
    return out


def _stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of known words of at least some length, a separator after each; and the place of each number."""
    edges = np.diff(np.concatenate([[0], (ids != 0).astype("i1"), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = end - begin >= shortest
    begin, sizes = begin[keep], (end - begin)[keep] + 1  # with the separator that follows; every text has one
    if not len(begin):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    place = np.arange(int(sizes.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return place, ids[place]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())


def count_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    """Into how many blocks the benchmark has to be dealt, so that none but with a single item passes the bound, or nearly so."""
    total = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 if total <= block_bytes else math.ceil(total / (block_bytes / 2))


def read_blocks(benchmark: DataFrame, n: int, window: int, block_bytes: int) -> Iterator[Patterns]:
    """The patterns of each block, one after another; a block that came out too large is cut further."""
    items = _items(benchmark)
    for k in range(n):
        held, size = [], 0
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator():
            more = len(r.text.encode("utf-8", "surrogatepass"))
            if held and size + more > block_bytes:
                yield Patterns(held, window)
                held, size = [], 0
            held.append((r.item_id, r.text))
            size += more
        if held:
            yield Patterns(held, window)


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task, a shard at a time."""
    held, size = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            b = whole.slice(at, 200)
            held.append(b)
            size += b.column(column).nbytes
            if size >= shard_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _hits_of(docs: DataFrame, patterns: Broadcast, shard_bytes: int) -> DataFrame:
    """(doc_id, text_hash, spans, items) of the rows of ``docs`` (doc_id, text_hash, text) that one block hits."""
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 2, shard_bytes):
            found = find(shard.column(2).to_pylist(), patterns.value)
            hit = shard.select([0, 1]).filter(pa.array([bool(s) for _, s, _ in found]))
            found = [x for x in found if x[1]]
            hit = hit.append_column("spans", pa.array([[{"begin": a, "end": b} for a, b in s] for _, s, _ in found], span))
            yield from hit.append_column("items", pa.array([x for _, _, x in found], pa.list_(pa.string()))).to_batches(max_chunksize=1000)

    return docs.mapInArrow(run, "doc_id long, text_hash long, spans array<struct<begin:int,end:int>>, items array<string>")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, shard_bytes: int) -> tuple[DataFrame, Broadcast | None]:
    """The rows of ``docs`` as struct ``row`` with their ``spans`` and ``items``; or, with the patterns of the only block, without: they are found by ``_hits``."""
    spark, n = docs.sparkSession, count_blocks(benchmark, block_bytes)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    broadcast = spark.sparkContext.broadcast
    if n == 1:
        return docs.select(row), broadcast(next(read_blocks(benchmark, 1, window, block_bytes), Patterns([], window)))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = []
    for patterns in read_blocks(benchmark, n, window, block_bytes):
        held = broadcast(patterns)
        parts.append(stash(_hits_of(texts, held, shard_bytes), "hits")[0])
        held.unpersist()
    hits = functools.reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    # Sets, so that equal rows bring their hits once.  Written, so that Spark can split hot keys of the join.
    merged = hits.agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged, _ = stash(merged, "merged-hits")
    rows = docs.select(row, docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"))
    return rows.join(merged, rows["own_id"].eqNullSafe(merged["hit_id"]) & (rows["own_hash"] == merged["hit_hash"]), "left").select("row", "spans", "items"), None


def _hits(shard: pa.Table, texts: list[str | None], patterns: Broadcast | None) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, hit spans and items of the rows of a shard."""
    if patterns is not None:
        return find(texts, patterns.value)
    spans, items = shard.column("spans").to_pylist(), shard.column("items").to_pylist()
    return [(len(split_words(t)), merge(s), sorted(i or [])) for t, s, i in zip(texts, spans, items, strict=True)]


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans of words in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or []):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    rows, patterns = _search(docs.select("doc_id", "text"), benchmark, window, block_bytes, shard_bytes)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 0, shard_bytes):
            ids, texts = shard.column(0).combine_chunks().flatten()
            found = _hits(shard, texts.to_pylist(), patterns)
            hit = [sum(b - a for a, b in s) for _, s, _ in found]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in found]
            columns = [n for n, _, _ in found], hit, [len(x) for _, _, x in found], digests, [h > 0 for h in hit]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans of words (and what stands between the words of a span)."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with what occurs in the benchmark cut out of ``text``, and ``n_chars`` (if there) made to fit."""
    names, at = docs.columns, docs.columns.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    rows, patterns = _search(docs, benchmark, window, block_bytes, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 0, shard_bytes):
            columns = shard.column(0).combine_chunks().flatten()
            old = columns[at].to_pylist()
            new = [t if t is None or not s else cut(t, s) for t, (_, s, _) in zip(old, _hits(shard, old, patterns), strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                sizes = [n if x is y else len(y) for n, x, y in zip(columns[count].to_pylist(), old, new, strict=True)]
                columns[count] = pa.array(sizes, columns[count].type)
            yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=1000)

    return rows.mapInArrow(run, T.StructType(docs.schema.fields))
