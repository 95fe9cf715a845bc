"""Greedy word-piece lengths of texts from a linear longest-match automaton.

The vocabulary is a trie over bytes; pieces that begin a word start with the
space byte, all others continue one.  Each node has a failure link and the number of pieces that are popped
when the link is taken; so a word's number of greedy longest-match pieces is
found in time linear in its length and no piece is ever built (Song et al.,
Fast WordPiece Tokenization, 2021).  A task steps the automaton over all of its
new distinct words at once, one symbol of every word at a time, and keeps the
lengths it has found in a table.

A word is a run of bytes other than space and 0x09-0x0D, matched as the space
byte and the run.  A word that the vocabulary cannot cover counts as one unknown
piece, as in WordPiece.

Defined cases: a null or empty text has no words and no pieces; every input row
gives one output row, repeated and null ids included; an empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import text_blocks
from bridgerec.llm.chunk_table import ChunkTable

#: Longer words are stepped alone, so that no matrix of words is wider.
WIDE = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: each byte that prints
    stands for itself, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as byte strings."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_symbols()
    return [bytes(table[ch] for ch in piece) for piece in vocab if all(ch in table for ch in piece)]


class LongestMatch:
    """Trie edges as one sorted key array, failure links and popped counts."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                nxt = children[at].get(s)
                if nxt is None:
                    nxt = children[at][s] = len(children)
                    children.append({})
                    final.append(False)
                at = nxt
            final[at] = at > 0
        fail, popped = [-1] * len(children), [0] * len(children)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for s, v in children[u].items():
                todo.append(v)
                if final[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and s not in children[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = children[z][s], n
        edges = sorted((u * 256 + s, v) for u, c in enumerate(children) for s, v in c.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([v for _, v in edges], np.int32)
        self.fail = np.array(fail, np.int32)
        self.popped = np.array(popped, np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next node of each state, -1 where there is no edge."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int32)
        key = state.astype(np.int64) * 256 + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 0 marks a word that cannot be covered."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        short = np.flatnonzero(sizes <= WIDE)
        if len(short):
            width = int(sizes[short].max())
            packed = np.array([words[i] for i in short], dtype=f"S{max(1, width)}")
            grid = packed.view(np.uint8).reshape(len(short), -1)
            out[short] = self._lengths(lambda j, live: grid[live, j], sizes[short])
        for i in np.flatnonzero(sizes > WIDE):
            row = np.frombuffer(words[i], np.uint8)
            out[i] = self._lengths(lambda j, live, row=row: row[j : j + 1], sizes[i : i + 1])[0]
        return out

    def _lengths(self, symbols, sizes: np.ndarray) -> np.ndarray:
        state, count = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        live = np.arange(len(sizes))
        for j in range(int(sizes.max()) if len(sizes) else 0):
            live = live[(sizes[live] > j) & (state[live] >= 0)]
            if not len(live):
                break
            todo, s = live, symbols(j, live)
            while len(todo):
                nxt = self.step(state[todo], s)
                hit = nxt >= 0
                state[todo[hit]] = nxt[hit]
                todo, s = todo[~hit], s[~hit]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
                stuck = state[todo] < 0
                todo, s = todo[~stuck], s[~stuck]
        todo = np.flatnonzero(state > 0)  # pieces still held after the last symbol
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        return np.where(state == 0, count, 0)


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(load_pieces(path))


@lru_cache(maxsize=2)
def lengths_table(path: str) -> ChunkTable:
    matcher = automaton(path)
    return ChunkTable(lambda words: matcher.lengths([b" " + w for w in words]).tolist())


def token_counts(
    docs: DataFrame,
    vocab_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)``: words, greedy pieces (an unknown
    word counts as one) and unknown words of each text."""
    schema = T.StructType(
        [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lengths_table(vocab_file)
        for batch in batches:
            rows = []
            for _, block in text_blocks(batch.column(1)):
                for found in table.values([t.split() for t in block]):
                    unknown = found.count(0)
                    rows.append((len(found), sum(found) + unknown, unknown))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
