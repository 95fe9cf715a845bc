"""Reading text columns from Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step works on; a longer single text is worked on alone.
BLOCK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts have at most ``size`` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of texts as UTF-8 bytes, each with its first row; null is an empty text."""
    data, offsets = text_bytes(column)
    for a, b in row_blocks(offsets, size):
        block, start = data[offsets[a] : offsets[b]].tobytes(), int(offsets[a])
        cuts = (offsets[a : b + 1] - start).tolist()
        yield a, [block[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the borders of the groups, from batches sorted by
    their first ``keys`` columns (integers without nulls).  A group is held until its
    end, so the caller bounds the size of groups."""
    kept = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = now if kept is None else pa.concat_tables([kept, now]).combine_chunks()
        if not table.num_rows:
            continue
        values = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(keys)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield table.slice(0, last), np.append(0, cuts)
        kept = table.slice(last).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept, np.array([0, kept.num_rows])
