"""Token-ID files: one independent zstandard frame a document.

A shard is a file in the public seekable zstandard layout: the frames, then a
skippable frame with the document index, then the seek table, which holds each
frame's compressed size, plain size and checksum (low 32 bits of XXH64).  Every
frame also ends in zstandard's own checksum.  A reader opens a shard's tail,
picks the frames it needs and decompresses only those.

Writing: the rows are range-partitioned by id and sorted inside partitions, so
shards and the documents in them ascend by id.  A task writes its shard under a
name of its own and renames it when it is whole; the manifest lists only files
of tasks that succeeded, so a lost executor or a second attempt leaves no wrong
file behind.  Files are reached through ``pyarrow.fs``, so the folder may be any
shared store that it knows.

Tokenizing: the tokenizer drops white space and splits on it, so the chunks
between ASCII white space are encoded apart; a block's distinct chunks are found by
Arrow, a task keeps a table of the ids of those it has met, and numpy puts the ids of
a block together.

Defined cases: a null text is an empty text and holds the end id alone; null ids
come first; rows with an equal id are all kept and ascend by text; an empty
table gives no shard and an empty manifest; only the named columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import text_blocks
from bridgerec.llm.chunk_table import ChunkTable, PackedTable
from bridgerec.llm.staging import shuffle_partitions

# Fixed values of the seekable zstandard layout.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX, CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D, 0x80
_FOOTER = struct.Struct("<IBI")
_SKIP = struct.Struct("<II")
#: Head of the document index: bytes of an id, documents, whether the first ones have no id.
_INDEX = struct.Struct("<BxxxII")
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


#: Entries of the table of chunks; this tokenizer is slow on new words.
ENTRIES = 800_000
#: Bytes of text whose distinct chunks are looked up together.
BLOCK = 1 << 22
#: Words that are encoded as one text.
JOINED = 500
#: Letters and marks on which the shortcuts of an encoder are tried, and the most marks that are cut off a word.
ALPHABET, MARKS, TAIL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?*#$&", 3


class ChunkEncoder:
    """Ids of texts through a table of distinct chunks between white space."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # chunks are independent only if white space is dropped; if not, texts are encoded whole
        apart = sum(map(self._ids, ("ab", "cd", "e")), [])
        self.by_chunk = self._ids("ab  cd\n e") == apart and not self._ids(" \n\t")
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        # further shortcuts, each taken only if the tokenizer shows that it changes nothing
        self.lower = self._ids(ALPHABET) == self._ids(ALPHABET.lower())
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.specials = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        ends = {x[-1:] for x in self.specials}  # a special token never ends in marks that are cut off
        marks = [m for m in MARKS if m.encode() not in ends and all(self._apart(c, m) for c in ALPHABET)]
        several = all(self._apart("A", x + y + z) for x in marks for y in marks for z in ("", x))
        self.marks = "".join(marks).encode() if several else b""
        self.tails: dict[bytes, bytes] = {}
        self.table = PackedTable(ENTRIES, f"<u{self.width}")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _apart(self, word: str, marks: str) -> bool:
        return self._ids(word + marks) == self._ids(word) + self._ids(marks)

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _encode_words(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters alone are one run of pieces whose last ends a word, so many
        are encoded at once and cut apart after these pieces."""
        words = [c for c in chunks if c.decode().isalpha()] if self.ends.any() else []
        parts = [b" ".join(words[i : i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        coded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in coded), f"<u{self.width}")
        cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
        if len(cuts) != len(words):  # some letters are split otherwise
            words, cuts = [], []
        packed, bounds = ids.tobytes(), [0, *(self.width * np.asarray(cuts, int)).tolist()]
        have = {w: packed[a:b] for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)}
        rest = [c for c in chunks if c not in have]
        have.update(zip(rest, self._encode(rest), strict=True))
        return have

    def _encode_new(self, chunks: list[bytes]) -> list[bytes]:
        """A letter and the marks that end the chunk are never in one piece, so the
        word before the marks is looked up or encoded by itself."""
        if not self.marks:
            return self._encode(chunks)
        stems = list(map(self._stem, chunks))
        cut = list({s for c, s in zip(chunks, stems, strict=True) if s is not c})
        entry = self.table.find(self.table.packed(pa.array(cut, pa.large_binary())))
        at = np.flatnonzero(entry >= 0)
        first, size, pool = self.table.first[entry[at]], self.table.size[entry[at]], self.table.pool
        have = {cut[k]: pool[a:b].tobytes() for k, a, b in zip(at.tolist(), first.tolist(), (first + size).tolist(), strict=True)}
        have.update(self._encode_words([c for c in set(stems) if c not in have]))
        return [have[s] if s is c else have[s] + self._tail(c[len(s) :]) for c, s in zip(chunks, stems, strict=True)]

    def _stem(self, chunk: bytes) -> bytes:
        """The chunk without its last marks, if they are few and a letter stands before them."""
        stem = chunk.rstrip(self.marks)
        return stem if 0 < len(chunk) - len(stem) <= TAIL and stem[-1:].isalpha() else chunk

    def _tail(self, marks: bytes) -> bytes:
        if (found := self.tails.get(marks)) is None:
            found = self.tails[marks] = array(self.code, self._ids(marks.decode())).tobytes()
        return found

    def _plain(self, text: bytes) -> bytes:
        """Lower case where that cannot touch a composition or make a special token."""
        if not (self.lower and text.isascii()):
            return text
        low = text.lower()
        return text if any(x in low for x in self.specials) else low

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width`` bytes."""
        if not self.by_chunk:
            return self._encode(texts)
        texts = list(map(self._plain, texts))
        ends = np.cumsum([0, *map(len, texts)])
        column = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])
        rows = pc.ascii_split_whitespace(column)
        chunks = rows.values.dictionary_encode()
        first, size, pool = self._looked_up(chunks.dictionary.cast(pa.large_binary()))
        which = chunks.indices.to_numpy()
        many = size[which]
        until = np.append(0, np.cumsum(many))
        ids = pool[np.arange(until[-1]) + np.repeat(first[which] - until[:-1], many)]
        cuts = until[rows.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def _looked_up(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct word begin in a pool, how many they are, and the pool."""
        ChunkTable.use(self.table)
        keys = self.table.packed(words)
        entry = self.table.find(keys)
        known, new = entry >= 0, np.flatnonzero(entry < 0)
        self.table.met[entry[known]] = True
        # an empty word, which Arrow leaves where white space begins or ends a text, has no ids
        pieces = self._encode_new(words.take(pa.array(new, pa.int64())).to_pylist())
        fresh = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        pool = np.concatenate([self.table.pool, np.frombuffer(b"".join(pieces), self.table.dtype)])
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[known], size[known] = self.table.first[entry[known]], self.table.size[entry[known]]
        first[new], size[new] = len(self.table.pool) + np.cumsum(fresh) - fresh, fresh
        if len(new):
            self.table.add(keys[:, new], first[new], fresh, pool)
        return first, size, pool


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_file)


class ShardWriter:
    """Writes one shard; ``close`` makes it visible under its final name."""

    def __init__(self, folder: str, shard: int, width: int, level: int = 3):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.shard, self.width, self.name = shard, width, f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        self.fs.create_dir(root, recursive=True)
        self.final, self.path = f"{folder}/{self.name}", f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.n_tokens += len(plain) // self.width

    def close(self) -> dict:
        nulls = sum(x is None for x in self.ids)
        index = _INDEX.pack(self.width, len(self.ids), nulls) + np.array(self.ids[nulls:], "<i8").tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(_SKIP.pack(SKIP_INDEX, len(index)) + index + _SKIP.pack(SKIP_SEEK, len(table)) + table)
        n_bytes = self.out.tell()
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return {
            "path": self.final,
            "shard": self.shard,
            "n_docs": len(self.ids),
            "n_tokens": self.n_tokens,
            "n_bytes": n_bytes,
        }


class ShardReader:
    """Reads a shard's tail and, on demand, single frames."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        count, flags, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums")
        length = count * _ENTRY.itemsize + _FOOTER.size
        start = size - length - _SKIP.size
        if _SKIP.unpack(self._read(start, _SKIP.size)) != (SKIP_SEEK, length):
            raise ValueError(f"{path}: the seek table's frame is damaged")
        self.entries = np.frombuffer(self._read(start + _SKIP.size, count * _ENTRY.itemsize), _ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        magic, length = _SKIP.unpack(self._read(int(self.offsets[-1]), _SKIP.size))
        if magic != SKIP_INDEX:
            raise ValueError(f"{path}: no document index")
        index = self._read(int(self.offsets[-1]) + _SKIP.size, length)
        self.width, docs, self.nulls = _INDEX.unpack_from(index)
        self.ids = np.frombuffer(index, "<i8", docs - self.nulls, _INDEX.size)
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def doc_id(self, frame: int) -> int | None:
        return None if frame < self.nulls else int(self.ids[frame - self.nulls])

    def frames_of(self, doc_ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.ids, doc_ids)) + self.nulls

    def frame(self, i: int) -> np.ndarray:
        """The ids of frame ``i``; raises if a checksum differs."""
        plain = self.unpacker.decompress(self._read(int(self.offsets[i]), int(self.entries["packed"][i])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["checksum"][i]:
            raise ValueError(f"frame {i}: checksum differs")
        return np.frombuffer(plain, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 3,
) -> DataFrame:
    """Encode and write every row; returns the manifest, one row a shard,
    ``(path, shard, n_docs, n_tokens, n_bytes)``.  The manifest is written to
    ``folder``/manifest, so nothing is encoded twice."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, writer = encoder(tokenizer_file), None
        end = b"" if end_id is None else int(end_id).to_bytes(enc.width, "little")
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = ShardWriter(folder, TaskContext.get().partitionId(), enc.width, level)
            ids = batch.column(0).to_pylist()
            for a, block in text_blocks(batch.column(1), BLOCK):
                for doc_id, coded in zip(ids[a : a + len(block)], enc.encode(block), strict=True):
                    writer.add(doc_id, coded + end)
        if writer is not None:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=to_arrow)

    to_arrow = pa.schema(
        [("path", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    parts.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the shards.

    ``start`` counts the ids of all documents before it over all shards.  With
    ``doc_ids`` only the frames of these documents are decompressed.
    """
    # one row a shard: their running count is small whatever the documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    )
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
    wanted = None if doc_ids is None else np.array(doc_ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(path)
                starts = start + np.concatenate([[0], np.cumsum(shard.entries["plain"].astype(np.int64))]) // shard.width
                frames = range(len(shard.entries)) if wanted is None else shard.frames_of(wanted).tolist()
                rows, held = [], 0
                for i in frames:
                    got = shard.frame(i).astype("<u4")
                    row = [shard.doc_id(i), int(starts[i]), len(got), zlib.crc32(got.tobytes())]
                    rows.append((*row, got.astype(np.int32)) if ids else row)
                    held += len(got) if ids else 1
                    if held >= 1 << 18:
                        yield pa.RecordBatch.from_arrays(columns(rows), names=schema.names)
                        rows, held = [], 0
                shard.close()
                yield pa.RecordBatch.from_arrays(columns(rows), names=schema.names)

    def columns(rows: list) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

    spread = shards.repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(run, schema)


def as_uri(folder: str) -> str:
    """``folder`` as the kind of URI that both Spark and pyarrow take."""
    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        return "file:///" + (rest if colon else scheme).lstrip("/")
    return folder
