"""Byte-level BPE ids of whole texts, from the ``tokenizers`` library.

Byte-level BPE never merges across pre-tokens.  A space followed by a visible
character always begins a pre-token, and a line feed between two visible
characters is one by itself.  A text is therefore cut there, a batch of texts at once in
Arrow; marks that end a chunk of letters are a pre-token too and are cut off.  Each different
piece of a batch is looked up once, and its ids, once encoded by the library, are remembered
in one array.  Look-ups of thousands of pieces at a time go by a hash and then compare the bytes,
so that no result rests on a hash.  Texts with a chunk for which the cut is not plainly safe (runs of white
space, control or exotic characters at its ends) are encoded as a whole, and so is every text
if the tokenizer does not pre-tokenize in this way.

``MAX_PIECES`` pieces at most are remembered; past that those that came in one batch only
are forgotten, which costs time and changes no result.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_PIECES = 600_000
#: Longer pieces are rare and not worth remembering.
MAX_PIECE_BYTES = 64
#: Pieces are looked up and encoded this many at a time.
LOOKED_UP, AT_ONCE = 1 << 13, 4096
#: Bytes of texts that callers had best pass at once.
BATCH_BYTES = 1 << 20
# Letters of which no Unicode version doubts that they are, and the ASCII marks.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A chunk begins with a character that surely is visible, or a space before one, and does not end in white space.
_SAFE = r"^ ?[!-~À-ɏ](?s:.*[^\s\x0b\x1c-\x1f\x85\pZ\pC])?$"
_WORD = f"^ ?[{_LETTERS}]+$"
_IN_WORD = " " + "".join(map(chr, [*range(65, 91), *range(97, 123), *[c for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)]]))

_VALUES = np.random.default_rng(20240302).integers(0, 1 << 64, 256, "u8")
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(LOOKED_UP * MAX_PIECE_BYTES, b, "u8")])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

_loaded: dict[str, Encoder] = {}


class _Row:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.room, self.n = np.zeros(1 << 10, kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            self.room = np.concatenate([self.all, np.zeros(max(end, len(self.room) * 3 // 2) - self.n, self.room.dtype)])
        self.room[self.n : end] = values
        self.n = end


def _bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings, and where each begins in them and the last ends."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, "i8")[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]] if data else np.zeros(0, "u1")
    return data, offsets - offsets[0]


class _Pieces:
    """Numbered pieces in an open-addressed table, and the ids of each; piece 0 is empty and has none.

    A piece with no bytes but ids is one that cannot be found.
    """

    def __init__(self):
        self.hash, self.begin, self.size, self.bytes = _Row("u8"), _Row("u4"), _Row("u1"), _Row("u1")
        self.start, self.count, self.ids = _Row("u4"), _Row("u4"), _Row("u4")
        self.batches = _Row("u1")
        self.slots = np.zeros(1 << 12, "i4")
        none = np.zeros(0, "i8")
        self.add(np.zeros(1, "u8"), none, np.zeros(1, "i8"), none, np.zeros(1, "i8"))

    @property
    def n(self) -> int:
        return self.hash.n

    @staticmethod
    def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each of up to LOOKED_UP pieces."""
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_VALUES[data] * _UP[: len(data)])])[offsets]
        h = (sums[1:] - sums[:-1]) * _DOWN[offsets[:-1]]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def add(self, hashes: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers of new pieces, given their bytes and ids end to end."""
        numbers = np.arange(self.n, self.n + len(sizes))
        self.begin.extend(self.bytes.n + np.cumsum(sizes) - sizes)
        self.start.extend(self.ids.n + np.cumsum(counts) - counts)
        for row, values in ((self.hash, hashes), (self.size, sizes), (self.bytes, data), (self.count, counts), (self.ids, ids), (self.batches, np.zeros(len(sizes), "u1"))):
            row.extend(values)
        if 2 * self.n > len(self.slots):
            self.slots = np.zeros(1 << (2 * self.n).bit_length(), "i4")
            self._place(np.flatnonzero(self.size.all))
        else:
            self._place(numbers[sizes > 0])
        return numbers

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hash.all[numbers] & np.uint64(mask)).astype("i8")
        while len(numbers):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & mask

    def find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of pieces; -1: unknown."""
        sizes, mask = np.diff(offsets), len(self.slots) - 1
        out = np.where(sizes == 0, 0, -1)
        left = np.flatnonzero(sizes)
        slot = (hashes[left] & np.uint64(mask)).astype("i8")
        while len(left):
            at = self.slots[slot]
            same = (self.hash.all[at] == hashes[left]) & (at > 0)
            out[left[same]] = at[same]
            on = ~same & (at > 0)
            left, slot = left[on], (slot[on] + 1) & mask
        found = np.flatnonzero(out > 0)
        alike = self.size.all[out[found]] == sizes[found]
        out[found[~alike]] = -1
        found = found[alike]
        mine = data[_places(offsets[found], sizes[found])]
        differ = np.flatnonzero(mine != self.bytes.all[_places(self.begin.all[out[found]], sizes[found])])
        if len(differ):
            out[found[np.searchsorted(np.cumsum(sizes[found]), differ, side="right")]] = -1
        return out

    def came(self, numbers: np.ndarray) -> None:
        """Count a batch, up to 255, for each of these different pieces."""
        self.batches.all[numbers] = np.minimum(self.batches.all[numbers], 254) + 1

    def some(self, numbers: np.ndarray) -> _Pieces:
        """Pieces of these numbers alone."""
        new = _Pieces()
        sizes, counts = self.size.all[numbers].astype("i8"), self.count.all[numbers].astype("i8")
        data, ids = self.bytes.all[_places(self.begin.all[numbers], sizes)], self.ids.all[_places(self.start.all[numbers], counts)]
        new.add(self.hash.all[numbers], data, sizes, ids, counts)
        new.batches.all[:] = 1
        return new


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        first = made.get("pre_tokenizer") or {}
        self.cuts = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not made.get("normalizer")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for x, i in self.tokenizer.get_vocab().items() if x.startswith("Ġ")]] = True
        self.known = _Pieces()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a process and file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts encoded one by one, laid end to end, and the number of each."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in lists for i in ids], "<u4"), np.array([len(x) for x in lists], "i8")

    def _joined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that each begin with their only space, encoded as one text.

        The only token of a chunk that holds a space is its first, so such tokens show where each begins.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([_bytes(chunks)[0].tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(chunks):
            return self._each(chunks.to_pylist())
        return ids, np.diff(np.append(begins, len(ids)))

    def _learn(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Remember the ids of new pieces; their numbers."""
        data, offsets = _bytes(pieces)
        spaced = data[offsets[:-1]] == ord(" ")
        numbers = np.zeros(len(pieces), "i8")
        for which, joined in ((np.flatnonzero(~spaced), False), (np.flatnonzero(spaced), True)):
            for at in range(0, len(which), AT_ONCE):
                places = which[at : at + AT_ONCE]
                some = pieces.take(pa.array(places))
                ids, counts = self._joined(some) if joined else self._each(some.to_pylist())
                own, ends = _bytes(some)
                numbers[places] = self.known.add(hashes[places], own, np.diff(ends), ids, counts)
        return numbers

    def _forget(self) -> None:
        """Keep the pieces that came in two batches and more, if they are not too many; and none that cannot be found."""
        stay = (self.known.batches.all > 1) & (self.known.size.all > 0)
        if 2 * stay.sum() > MAX_PIECES:
            stay[:] = False
        self.known = self.known.some(np.flatnonzero(stay))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of up to LOOKED_UP different pieces, each known afterwards."""
        sizes = pc.binary_length(pieces).to_numpy()
        if sizes.max() > MAX_PIECE_BYTES:
            numbers, long = np.zeros(len(pieces), "i8"), sizes > MAX_PIECE_BYTES
            ids, counts = self._each(pieces.filter(pa.array(long)).to_pylist())
            numbers[long] = self.known.add(np.zeros(len(counts), "u8"), ids[:0], np.zeros(len(counts), "i8"), ids, counts)
            if not long.all():
                numbers[~long] = self._numbers(pieces.filter(pa.array(~long)))
            return numbers
        data, offsets = _bytes(pieces)
        hashes = self.known.hashes(data, offsets)
        numbers = self.known.find(data, offsets, hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn(pieces.take(pa.array(new)), hashes[new])
        return numbers

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pieces, each known afterwards."""
        coded = pieces.dictionary_encode()
        different = coded.dictionary
        numbers = np.concatenate([self._numbers(different.slice(at, LOOKED_UP)) for at in range(0, len(different), LOOKED_UP)])
        self.known.came(numbers)
        return numbers[coded.indices.to_numpy()]

    def flat(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts laid end to end (unsigned 32-bit), and the number of each; a null or empty text has none."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        array = array.cast(pa.large_string()).fill_null("")
        if not len(array):
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        if not self.cuts:
            return self._each(array.to_pylist())
        if self.known.n > MAX_PIECES or self.known.ids.n > 8 * MAX_PIECES:
            self._forget()
        odd = pc.match_substring(array, "\0")
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", array), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        chunks, code = coded.dictionary, coded.indices.to_numpy()
        safe = pc.or_(pc.match_substring_regex(chunks, _SAFE), pc.equal(chunks, "\n"))
        base = pc.utf8_rtrim(chunks, _MARKS)
        word = pc.match_substring_regex(base, _WORD)
        base = pc.if_else(safe, pc.if_else(word, base, chunks), "")
        marks = pc.if_else(word, pc.utf8_ltrim(chunks, _IN_WORD), "")
        pieces = np.column_stack([self._look_up(base), self._look_up(marks)]).ravel()
        # The ids of the different chunks are laid end to end first, which is little enough to stay near.
        sizes = self.known.count.all[pieces].astype("i8")
        different = self.known.ids.all[_places(self.known.start.all[pieces], sizes)]
        sizes = sizes.reshape(-1, 2).sum(1)
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(sizes[code])])
        counts = np.diff(before[ends], prepend=0)
        ids = different[_places(starts[code], sizes[code])]
        # An unsafe chunk, the empty one for one, gives its text away to the library.
        unsafe = np.concatenate([[0], np.cumsum(~safe.to_numpy(zero_copy_only=False)[code])])[ends]
        whole = odd.to_numpy(zero_copy_only=False) | (np.diff(unsafe, prepend=0) > 0)
        whole &= pc.binary_length(array).to_numpy() > 0
        if not whole.any():
            return ids, counts
        which = np.flatnonzero(whole).tolist()
        others, numbers = self._each(array.take(pa.array(which)).to_pylist())
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, some in zip(which, np.split(others, np.cumsum(numbers)[:-1]), strict=True):
            parts[k] = some
        counts[which] = numbers
        return np.concatenate(parts), counts

    def flat_ended(self, texts: list[str | None] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id after each text."""
        ids, counts = self.flat(texts)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.flat(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of each run, ``sizes[k]`` of them, one run after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts.astype("i8") - (np.cumsum(sizes) - sizes), sizes)


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES):
    """A batch in parts of up to ``limit`` bytes of a text column; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop
    pa.default_memory_pool().release_unused()
