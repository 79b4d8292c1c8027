"""Repeated passages by suffix sorting with bucket-pointer refinement.

Texts are UTF-8 bytes.  A byte is covered if it is part of a string of ``length`` bytes
that starts at another place too, in the same text or another; matches never cross
texts, and strings are judged on the input.  A *passage* is a maximal run of covered bytes.
``measure`` and ``remove`` take all of them out, or, with ``least_words``, those of so
many words or ``LENGTH`` bytes (writing without spaces has long words).  ``measure`` can count the
latter beside the former (``passages``): shorter strings are then sought first, and the longer ones
only inside the runs of those, for every part of a repeated string repeats as well.

*Dealing.*  In every string of ``length`` bytes one place is its anchor: that where the least
hash of a piece of ``Sizes.gram`` bytes begins (the first, if several).  Equal strings have equal
anchors, so only the strings of equal anchor pieces need comparing; of strings of 400 bytes about
one place in 170 is an anchor.  The context of an anchor is all bytes of its strings, at most
``2 * length - gram``, however periodic a text is, for an anchor lies in all its strings.  Anchors go as
a few numbers each to the task of their piece: pieces that come once are done with, and so
are equal contexts (64-bit hashes beside those of the piece), all of whose strings repeat.
Only pieces whose contexts differ have one context of each kind read.

*Sorting.*  Contexts that share pieces are sorted together.  Places are first put into
buckets of equal q-grams (q is ``Sizes.step``); then buckets are refined by sorting their places on
the bucket identifiers q places later, those of the result again by its own
identifiers twice as far on, and so on to ``length``.  Places alone in their bucket
drop out.  Two places in one last bucket begin equal strings.  (The first buckets go by a
64-bit hash; a string is eight of them and more, so that a false match takes a collision
between strings that are equal elsewhere.)

*Hot pieces.*  A piece with more than ``CHUNK`` different contexts is sorted in chunks, of at most
``CHUNK * (2 * length - gram)`` bytes (3 MB at 400), whatever the input;
what a chunk does not settle goes on as packed hashes of strings, parted by hash, so
that no task gets more than a chunk's worth, and no row is made for a string.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing (an
empty text's digest is that of no bytes); repeated rows and repeated or null doc_ids are
rows like others, so a long enough repeated row loses everything; the spans of n equal rows are
kept once, not n times n; an empty table gives
an empty result; ``remove`` carries other columns, ``measure`` ignores them.  Texts are
read whole, at any length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm._shared import scratch, stash

LENGTH = 400
#: Different contexts of a piece that are sorted together at most.
CHUNK = 4096
#: Bytes of texts hashed at once, and of contexts sorted at once.
BLOCK, SORTED = 1 << 19, 2 << 20


@dataclass(frozen=True)
class Sizes:
    """Bytes of the strings sought, and of the work on them; workers get it as an argument."""

    length: int = LENGTH
    block: int = BLOCK
    sorted: int = SORTED

    def __post_init__(self):
        if self.length < 16:
            raise ValueError("strings of fewer than 16 bytes are not sought")

    @property
    def gram(self) -> int:
        """Bytes of an anchor's piece."""
        return self.length * 4 // 25

    @property
    def step(self) -> int:
        """Bytes of a q-gram."""
        return self.length // 8


_BITS = 22  # places in a block
_MASK = np.uint64((1 << _BITS) - 1)

_rng = np.random.default_rng(20240229)
_VALUES = [_rng.integers(0, 1 << 64, 256, "u8") for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, BLOCK + LENGTH)  # room for the usual block
        base = _BASES[which]
        _powers[which] = tuple(np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size - 1, b, "u8")])) for b in (base, pow(base, -1, 1 << 64)))
    return tuple(x[:n] for x in _powers[which])


def hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``length`` bytes in a row."""
    n = len(data) - length + 1
    up, down = _powers_of(which, len(data))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_VALUES[which][data] * up)])
    h = (sums[length:] - sums[:-length]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo("u8").max, "u8")
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(grid, axis=1).ravel()
    from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def anchors(data: bytes, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchors of texts laid end to end: (text, place, first string, last string, piece, context)."""
    array = np.frombuffer(data, "u1")
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, "i8") for _ in range(6))
    piece = hashes(array, gram)
    keys = (piece & ~_MASK) | np.arange(len(piece), dtype="u8")
    least = (_least(keys, length - gram + 1) & _MASK).astype("i8")
    strings = np.arange(int(counts.sum())) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    at = least[strings]
    text = np.repeat(np.arange(len(sizes)), counts)
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first, last = strings[begins], strings[np.append(begins[1:], len(strings)) - 1]
    digest = xxhash.xxh3_64_intdigest
    context = np.array([digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], "u8").view("i8")
    base = (ends - sizes)[text[begins]]
    return text[begins], at[begins] - base, first - base, last - base, piece[at[begins]].view("i8"), context


_ANCHOR = "doc_id long, text_hash long, place long, first long, last long, piece long, context long"
_NAMES = [x.split()[0] for x in _ANCHOR.split(", ")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def _blocks(texts: list[bytes], of: Sizes) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts long enough, together up to a block of bytes; longer ones in overlapping parts with their starts."""
    which, starts, parts, size = [], [], [], 0
    for k, data in enumerate(texts):
        if len(data) < of.length:
            continue
        for start in range(0, len(data) - of.length + 1, of.block):
            part = data[start : start + of.block + of.length - 1]
            if parts and size + len(part) > of.block + of.length:
                yield which, starts, parts
                which, starts, parts, size = [], [], [], 0
            which.append(k)
            starts.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield which, starts, parts


def _find_anchors(batches: Iterator[pa.RecordBatch], of: Sizes, inside: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, data), and with ``inside`` the spans of strings of so many bytes to stay in, to rows of _ANCHOR."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            ids, text_hash, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            owner, base = np.arange(len(texts)), np.zeros(len(texts), "i8")
            if inside:
                runs = [(k, a, z) for k, some in enumerate(merge(b.column(3), inside)) for a, z in some]
                texts = [texts[k][a:z] for k, a, z in runs]
                owner, base = np.array([k for k, _, _ in runs], "i8"), np.array([a for _, a, _ in runs], "i8")
            for which, starts, parts in _blocks(texts, of):
                text, place, first, last, piece, context = anchors(b"".join(parts), np.array([len(p) for p in parts]), of.length, of.gram)
                if not len(text):
                    continue
                row = pa.array(owner[which][text])
                start = (base[which] + np.array(starts, "i8"))[text]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), text_hash.take(row), *(pa.array(x) for x in (place + start, first + start, last + start, piece, context))], names=_NAMES
                )


def refine(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, step: int = LENGTH // 8) -> np.ndarray:
    """For each place of contexts laid end to end, the bucket of its string; -1 where it is alone or passes the end.

    ``ends`` has for each place the end of its context.
    """
    n = len(data)
    bucket = np.full(n, -1, "i8")
    places = np.flatnonzero(np.arange(n) + step <= ends)
    bucket[places] = _number(hashes(data, step)[places]) if len(places) else 0
    depth = step
    while depth < length:
        further = min(depth, length - depth)
        # Both halves have to be shared by others; what is alone drops out here.
        places = places[places + depth + further <= ends[places]]
        places = places[(bucket[places] >= 0) & (bucket[places + further] >= 0)]
        new = np.full(n, -1, "i8")
        if len(places):
            new[places] = _number(bucket[places] * (int(bucket.max()) + 1) + bucket[places + further])
        bucket, depth = new, depth + further
    return bucket


def _number(keys: np.ndarray) -> np.ndarray:
    """Numbers of equal keys, in order; -1 for keys that come once."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    out = np.empty(len(keys), "i8")
    out[order] = np.where(alone, -1, np.cumsum(new) - 1)
    return out


_FOUND = "doc_id long, text_hash long, first long, last long, piece long, part int, packed binary"
_ENTRY = np.dtype([("one", "<u8"), ("two", "<u8"), ("unit", "<i4"), ("string", "<i8")])
_UNIT = np.dtype([("doc_id", "<i8"), ("no_id", "?"), ("text_hash", "<i8")])


def _runs(flags: np.ndarray, unit: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged strings as runs (unit, first, last)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    u, s = unit[at], string[at]
    begin = np.concatenate([[True], (u[1:] != u[:-1]) | (s[1:] != s[:-1] + 1)])
    begins = np.flatnonzero(begin)
    return u[begins], s[begins], s[np.append(begins[1:], len(at)) - 1]


def _spans_batch(doc_id: list, text_hash: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
        names=[x.split()[0] for x in _FOUND.split(", ")],
    )


def _sort_contexts(batches: Iterator[pa.RecordBatch], of: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows (piece, chunk, chunks, times, doc_id, text_hash, first, bytes), sorted by piece and chunk, to rows of _FOUND."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size >= of.sorted and held[-1][:2] != row[:2]:
                yield from _sort_block(held, of)
                held, size = [], 0
            held.append(row)
            size += len(row[7])
    if held:
        yield from _sort_block(held, of)


def _sort_block(rows: list[tuple], of: Sizes) -> Iterator[pa.RecordBatch]:
    piece, _, chunks, times, doc_id, text_hash, first, contexts = zip(*rows, strict=True)
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), "u1")
    stops = np.cumsum(sizes)
    begins = stops - sizes
    bucket = refine(data, np.repeat(stops, sizes), of.length, of.step)
    # The strings of all units, one after another.
    counts = sizes - of.length + 1
    unit = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begins[unit] + offset
    shared = bucket[place] >= 0
    once = np.array(times)[unit] == 1
    string = np.array(first, "i8")[unit] + offset
    hash_of = np.array(text_hash, "i8")
    u, a, z = _runs(shared & once, unit, string)
    if len(u):
        yield _spans_batch([doc_id[k] for k in u.tolist()], hash_of[u], a, z)
    many = np.array(chunks) > 1
    if not many.any():
        return
    one, two = hashes(data, of.length, 0)[place], hashes(data, of.length, 1)[place]
    pieces = np.array(piece, "i8")
    for p in np.unique(pieces[many]).tolist():
        mine = np.flatnonzero(pieces[unit] == p)
        parts = int(np.array(chunks)[pieces == p][0])
        settled = shared[mine] | ~once[mine]
        entries = np.zeros(len(mine), _ENTRY)
        entries["one"], entries["two"], entries["string"] = one[mine], two[mine], string[mine]
        entries["unit"] = np.where(settled, -1, unit[mine])
        # Settled strings go on once each, for those that other chunks have.
        _, keep = np.unique(entries[["one", "two"]][settled], return_index=True)
        entries = np.concatenate([entries[settled][keep], entries[~settled]])
        part = (entries["one"] % np.uint64(parts)).astype("i4")
        for k in range(parts):
            some = entries[part == k]
            used, some["unit"][some["unit"] >= 0] = np.unique(some["unit"][some["unit"] >= 0], return_inverse=True)
            units = np.zeros(len(used), _UNIT)
            units["doc_id"] = [doc_id[x] or 0 for x in used.tolist()]
            units["no_id"] = [doc_id[x] is None for x in used.tolist()]
            units["text_hash"] = hash_of[used]
            packed = np.int64(len(units)).tobytes() + units.tobytes() + some.tobytes()
            nulls = [pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([p], pa.int64()), pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=[x.split()[0] for x in _FOUND.split(", ")])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings (piece, part, packed), sorted by piece and part, to rows (doc_id, text_hash, first, last)."""
    at, held = None, []
    for b in batches:
        for piece, part, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at is not None and at != (piece, part):
                yield from _settle_part(held)
                held = []
            at = piece, part
            held.append(packed)
    if held:
        yield from _settle_part(held)


def _settle_part(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    all_units, all_entries, n = [], [], 0
    for blob in blobs:
        k = int(np.frombuffer(blob, "<i8", 1)[0])
        units = np.frombuffer(blob, _UNIT, k, 8)
        entries = np.frombuffer(blob, _ENTRY, -1, 8 + k * _UNIT.itemsize).copy()
        entries["unit"][entries["unit"] >= 0] += n
        n += k
        all_units.append(units)
        all_entries.append(entries)
    units, entries = np.concatenate(all_units), np.concatenate(all_entries)
    order = np.lexsort((entries["two"], entries["one"]))
    e = entries[order]
    same = (e["one"][1:] == e["one"][:-1]) & (e["two"][1:] == e["two"][:-1])
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    e = e[shared & (e["unit"] >= 0)]
    e = e[np.lexsort((e["string"], e["unit"]))]
    u, a, z = _runs(np.ones(len(e), bool), e["unit"], e["string"])
    if len(u):
        ids = [None if none else i for i, none in zip(units["doc_id"][u].tolist(), units["no_id"][u].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units["text_hash"][u]), pa.array(a), pa.array(z)], names=["doc_id", "text_hash", "first", "last"])


def repeated_strings(docs: DataFrame, of: Sizes = Sizes(), within: DataFrame | None = None, inside: int = 0) -> DataFrame:
    """Runs (doc_id, text_hash, first, last) of places where repeated strings start; those of equal rows may come more than once.

    ``within`` has the spans (see ``_spans``) of all repeated strings of ``inside`` bytes, no more than are sought; no others are looked at.
    """
    texts = _texts(docs)
    if within is not None:
        ends = [F.array_max(F.col("spans.last")) + inside, F.array_min(F.col("spans.first"))]
        texts = _of_text(texts, texts["doc_id"], texts["text_hash"], within.where(ends[0] - ends[1] >= of.length), "inner").select("doc_id", "text_hash", "data", "spans")
    found, _ = stash(texts.mapInArrow(functools.partial(_find_anchors, of=of, inside=inside), _ANCHOR), "anchors")
    # Aggregates are written before they are joined: Spark splits the hot keys of a join only if it deals out both sides for it.
    often, _ = stash(found.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece"), "repeated-pieces")
    repeated, _ = stash(found.join(often, "piece"), "repeated-anchors")
    some = F.struct("doc_id", "text_hash", "place", "first", "last")
    units, _ = stash(repeated.groupBy("piece", "context").agg(F.count("*").alias("times"), F.min(some).alias("one")), "contexts")
    copies = repeated.join(units.where("times > 1").select("piece", "context"), ["piece", "context"]).select("doc_id", "text_hash", "first", "last")
    kinds, _ = stash(units.groupBy("piece").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-pieces")
    chunks = F.ceil(F.col("kinds") / CHUNK).cast("int")
    mixed = units.join(kinds, "piece").select("piece", F.pmod(F.xxhash64("context"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"), "times", "one.*")
    asked = mixed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("piece", "chunk", "chunks", "times", "first", "last")).alias("units"))
    texts, asked = _texts(docs), asked.withColumnRenamed("doc_id", "asked_id").withColumnRenamed("text_hash", "asked_hash")
    joined = texts.join(asked, texts["doc_id"].eqNullSafe(asked["asked_id"]) & (texts["text_hash"] == asked["asked_hash"]))
    unit = F.explode("units").alias("u")
    # Bytes are cut out here, so that only contexts are dealt out again.
    contexts = joined.select("doc_id", "text_hash", "data", unit).select(
        "u.piece", "u.chunk", "u.chunks", "u.times", "doc_id", "text_hash", "u.first", F.expr(f"substring(data, cast(u.first + 1 as int), cast(u.last - u.first + {of.length} as int))").alias("bytes")
    )
    # Equal rows each bring the context that only one of them has to; their contexts come more than once, so others need no look.
    contexts = contexts.where("times = 1").unionByName(contexts.where("times > 1").dropDuplicates(["piece", "chunk", "doc_id", "text_hash", "first"]))
    dealt = contexts.repartition("piece", "chunk").sortWithinPartitions("piece", "chunk")
    sorted_, _ = stash(dealt.mapInArrow(functools.partial(_sort_contexts, of=of), _FOUND), "sorted")
    span = ["doc_id", "text_hash", "first", "last"]
    packed = sorted_.where(F.col("packed").isNotNull()).select("piece", "part", "packed").repartition("piece", "part").sortWithinPartitions("piece", "part")
    return copies.unionByName(sorted_.where(F.col("packed").isNull()).select(span)).unionByName(packed.mapInArrow(_settle, "doc_id long, text_hash long, first long, last long"))


def _of_text(rows: DataFrame, doc_id: Column, text_hash: Column, spans: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the ``spans`` of their texts."""
    return rows.join(spans, doc_id.eqNullSafe(spans["span_id"]) & (text_hash == spans["span_hash"]), how)


def _spans(docs: DataFrame, of: Sizes, within: DataFrame | None = None, inside: int = 0) -> DataFrame:
    """(span_id, span_hash, spans) of the texts with repeated strings, written."""
    with scratch(docs.sparkSession) as keep:
        runs = repeated_strings(docs, of, within, inside)
        # A set, so that the runs of n equal rows are held once and not n times by each.
        by_text = runs.groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
        by_text, path = stash(by_text, "spans")
        keep(path)
    return by_text


def _with_spans(docs: DataFrame, of: Sizes, shorter: Sizes | None = None) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with array ``spans`` of their repeated strings (null: none), and ``passages``, those of ``shorter`` ones."""
    if shorter is None:
        spans = _spans(docs, of)
    else:
        passages = _spans(docs, shorter)
        keys = [F.col(c).alias(f"long_{c}") for c in ("span_id", "span_hash")]
        longer = _spans(docs, of, passages, shorter.length).select(*keys, "spans")
        same = passages["span_id"].eqNullSafe(longer["long_span_id"]) & (passages["span_hash"] == longer["long_span_hash"])
        spans = passages.withColumnRenamed("spans", "passages").join(longer, same, "left").select("span_id", "span_hash", "spans", "passages")
    # The rows travel inside a struct, so that none of their names can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"))
    return _of_text(rows, rows["own_id"], rows["own_hash"], spans, "left").select("row", "spans", *([] if shorter is None else ["passages"]))


def merge(spans: pa.Array, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Maximal runs [begin, end) of covered bytes, from the lists of spans of some texts."""
    counts = spans.value_lengths().fill_null(0).to_numpy()
    first, last = (x.to_numpy() for x in spans.flatten().flatten())
    runs: list[list[tuple[int, int]]] = [[] for _ in counts]
    if not len(first):
        return runs
    # All texts at once: each has its own stretch of the numbers.
    stretch = int(last.max()) + length + 1
    base = np.repeat(np.arange(len(counts)), counts) * stretch
    order = np.argsort(base + first)
    begin, end = (base + first)[order], np.maximum.accumulate((base + last + length)[order])
    starts = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    stops = end[np.append(starts[1:], len(begin)) - 1]
    of, starts = divmod(begin[starts], stretch)
    for k, a, z in zip(of.tolist(), starts.tolist(), (stops - of * stretch).tolist(), strict=True):
        runs[k].append((a, z))
    return runs


def _passages(data: bytes, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """The runs to take out of a text."""
    if not least_words:
        return runs
    return [(a, z) for a, z in runs if z - a >= LENGTH or len(data[a:z].split()) >= least_words]


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def measure(docs: DataFrame, of: Sizes = Sizes(), least_words: int = 0, passages: tuple[Sizes, int] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row; ``text`` is what is left, without characters of which a part is gone.

    With ``passages``, sizes of no longer strings and a number of words, ``n_passages`` and ``n_passage_bytes`` follow: the runs
    that ``remove`` would take out of the input at these, which are not taken out here.
    """
    if passages and passages[0].length > of.length:
        raise ValueError(f"passages are sought by strings of at most {of.length} bytes, not {passages[0].length}")
    names, kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"], [pa.int64()] * 3 + [pa.string()] * 2
    if passages:
        names, kinds = [*names, "n_passages", "n_passage_bytes"], [*kinds, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                rows = []
                lengths = [of.length, *([passages[0].length] if passages else [])]
                for text, runs, *shorter in zip(b.column(1).to_pylist(), *map(merge, b.columns[2:], lengths), strict=True):
                    data = text or b""
                    runs = _passages(data, runs, least_words)
                    kept = _cut(data, runs) if runs else data
                    row = len(data), sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")
                    if passages:
                        seen = _passages(data, shorter[0], passages[1])
                        row = *row, len(seen), sum(z - a for a, z in seen)
                    rows.append(row)
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    rows = _with_spans(docs.select("doc_id", "text"), of, passages[0] if passages else None)
    rows = rows.select("row.doc_id", F.col("row.text").cast("binary").alias("data"), *rows.columns[1:])
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))]))


def remove(docs: DataFrame, of: Sizes = Sizes(), least_words: int = 0) -> DataFrame:
    """``docs`` without their repeated passages; a character of which a part is removed goes too, and ``n_chars`` is made to fit."""
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def kept(text: str | None, runs: list[tuple[int, int]]) -> str | None:
        if not runs:
            return text
        data = text.encode()
        runs = _passages(data, runs, least_words)
        return _cut(data, runs).decode("utf-8", "ignore") if runs else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                columns, runs = b.column(0).flatten(), merge(b.column(1), of.length)
                old = columns[at].to_pylist()
                new = [kept(t, r) for t, r in zip(old, runs, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if count is not None:
                    sizes = [n if t is o else len(t) for t, o, n in zip(new, old, columns[count].to_pylist(), strict=True)]
                    columns[count] = pa.array(sizes, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_spans(docs, of).mapInArrow(run, T.StructType(docs.schema.fields))
