"""A task's table of distinct chunks and what was computed for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Entries of the younger generation of a table; the older one has about as many.
ENTRIES = 150_000
#: Longer chunks are computed without being kept.
KEPT_BYTES = 48


class ChunkTable:
    """Two generations: a chunk that is met again moves to the younger one, and
    when that is full the older one goes.  Memory is bounded and frequent chunks
    stay; a chunk that was dropped is only computed again.  A worker process serves
    many tasks, so a table that is put to use empties the one that was used before, and
    tasks that use none call :meth:`leave` for what an earlier operator left."""

    in_use: ChunkTable | PackedTable | None = None

    def __init__(self, compute: Callable[[list[bytes]], list], entries: int = ENTRIES):
        self.compute, self.entries = compute, entries
        self.young: dict = {}
        self.old: dict = {}

    @classmethod
    def leave(cls) -> None:
        """Empty the worker's table in use, and give back what Arrow keeps of freed batches."""
        if (other := cls.in_use) is not None:
            other.clear()
            cls.in_use = None
        pa.default_memory_pool().release_unused()

    @classmethod
    def use(cls, table: ChunkTable | PackedTable) -> None:
        """From now on ``table`` is the worker's table in use."""
        if cls.in_use is not table:
            cls.leave()
            cls.in_use = table

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def get(self, chunk: bytes):
        """What is known of a chunk, else None."""
        found = self.young.get(chunk)
        return self.old.get(chunk) if found is None else found

    def values(self, rows: list[list[bytes]]) -> Iterator[list]:
        """What is computed for the chunks of each row."""
        ChunkTable.use(self)
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        chunks = list(chain.from_iterable(rows))
        found = list(map(self.young.get, chunks))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            missing = {chunks[i] for i in gaps}
            here = {c: v for c in missing if (v := self.old.get(c)) is not None}
            new = [c for c in missing if c not in here]
            here.update(zip(new, self.compute(new), strict=True))
            self.young.update((c, v) for c, v in here.items() if len(c) <= KEPT_BYTES)
            for i in gaps:
                found[i] = here[chunks[i]]
        at = 0
        for row in rows:
            yield found[at : at + len(row)]
            at += len(row)


class PackedTable:
    """The ids of distinct words, whole blocks at a time and without an object a word.

    A word of at most ``PACKED_BYTES`` is three 64-bit integers, its bytes and its length, so
    words are compared whole; longer ones are never kept.  When the table is full, the words
    that were met again since the last time stay, half of the table at most."""

    PACKED_BYTES = 23

    def __init__(self, entries: int, dtype: str):
        self.entries, self.dtype, self.bits = entries, dtype, (2 * entries - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(0, -1, np.int32)
        self.keys = np.empty((3, 0), np.uint64)
        self.first, self.size, self.met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.pool = np.empty(0, self.dtype)

    def packed(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """The integers of each word; all ones for those too long."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size = np.diff(offsets)
        data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[:1].sum() : offsets[-1:].sum()], np.zeros(32, np.uint8))
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        ones = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        fits, at = size <= self.PACKED_BYTES, offsets[:-1] - offsets[:1].sum()
        keys = np.stack([eights[np.minimum(at + k, len(eights) - 1)] & ones[np.clip(size - k, 0, 8)] for k in (0, 8, 16)])
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        keys[:, ~fits] = ones[8]
        return keys

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 for one that is not here."""
        out = np.full(keys.shape[1], -1, np.int64)
        if not len(self.slots):
            return out
        at, todo = self._home(keys), np.arange(keys.shape[1])
        while len(todo):
            entry = self.slots[at[todo]].astype(np.int64)
            same = (entry >= 0) & (self.keys[:, entry] == keys[:, todo]).all(axis=0)
            out[todo[same]] = entry[same]
            todo = todo[(entry >= 0) & ~same]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Take in distinct words that are not here; ``pool`` holds the ids of the table and theirs."""
        short = np.flatnonzero(keys[2] != np.uint64(2**64 - 1))[: self.entries // 2]
        old = np.arange(len(self.size))
        if len(old) + len(short) > self.entries:
            old = np.flatnonzero(self.met)[-(self.entries // 2) :]
        full = len(old) < len(self.size) or not len(self.slots)
        first, size = np.append(self.first[old], first[short]), np.append(self.size[old], size[short])
        keys = np.hstack([self.keys[:, old], keys[:, short]])
        until = np.append(0, np.cumsum(size))
        self.pool = pool[np.arange(until[-1]) + np.repeat(first - until[:-1], size)]
        self.keys, self.first, self.size = keys, until[:-1], size
        self.met = np.append(np.zeros(len(old), bool) if full else self.met, np.zeros(len(short), bool))
        if full:
            self.slots = np.full(1 << self.bits, -1, np.int32)
        at, entry = self._home(keys), np.arange(len(size))
        todo = entry if full else entry[len(old) :]
        while len(todo):  # of the words that want one free slot, the last gets it
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = free
            todo = todo[self.slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
