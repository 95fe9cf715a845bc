"""SentencePiece encoding and decoding through a table of distinct chunks.

A vocabulary whose pieces hold the whitespace marker only as a leading run can
never merge over the border between a word and the next marker.  The text then
falls into chunks (markers, then a word) that are segmented independently.  Each
task keeps a table of the distinct chunks it has met, lets the sentencepiece
library segment a chunk once, and joins the ids back by position.

A vocabulary that has a crossing piece, or a model that normalises its input,
is encoded text by text instead, so the result is always the library's own.

Defined cases: a null text is an empty text; repeated rows, repeated ids and
null ids are kept, one output row for each input row; an empty table gives an
empty table; only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import text_blocks
from bridgerec.llm.chunk_table import ChunkTable

MARK = "▁"
#: For texts with runs of spaces: a run of spaces and the word that follows.
_CHUNK = re.compile(rb" +[^ ]*")
#: Strings on which a normalising model would differ from one that leaves its input alone.
_PROBES = ("a  b ", " a", "ﬁ①", "é", " x", "A\tB\nC", "Ａ")


class ChunkCodec:
    """Encodes and decodes with a sentencepiece model by distinct chunks."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.sp.get_piece_size()
        crossing = any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(n))
        kept = all(self.sp.decode(self.sp.encode(x)) == x for x in _PROBES)
        self.by_chunk = kept and not crossing
        self.mark_id = self.sp.piece_to_id(MARK)
        self.table = ChunkTable(self._segment)
        self.begin, self.end = (np.uint32(x()).tobytes() for x in (self.sp.bos_id, self.sp.eos_id))

    def _segment(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks without their first marker, which the library adds."""
        ids = self.sp.encode([c.decode() for c in chunks], num_threads=1)
        # the library adds no marker to an empty text, so a lone marker is looked up
        return [array("I", i if c else [self.mark_id]).tobytes() for i, c in zip(ids, chunks, strict=True)]

    def _chunks(self, text: bytes) -> list[bytes]:
        text = text.replace(MARK.encode(), b" ")
        if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return [c[1:] for c in _CHUNK.findall(b" " + text)]
        return text.split(b" ") if text else []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """All ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            found = [array("I", i).tobytes() for i in self.sp.encode([t.decode() for t in texts], num_threads=1)]
            return [self.begin + i + self.end for i in found]
        rows = [self._chunks(t) for t in texts]
        return [b"".join([self.begin, *ids, self.end]) for ids in self.table.values(rows)]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(model_file: str) -> ChunkCodec:
    return ChunkCodec(model_file)


def sentencepiece_codec(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids: bool = True,
    decoded: bool = True,
    digests: bool = False,
) -> DataFrame:
    """``(id, n_tokens[, ids][, decoded][, ids_sha256, decoded_sha256])`` for each row of ``docs``.

    ``ids`` is ``array<int>`` with begin and end; ``decoded`` is the library's
    decoding of them.  The digests are over the ids as little-endian unsigned
    32-bit integers and over the decoded text in UTF-8.
    """
    key = docs.schema[id_col]
    fields = [key, T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField("decoded", T.StringType())] * decoded
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        for batch in batches:
            for first, block in text_blocks(batch.column(1)):
                out: dict[str, list] = {f.name: [] for f in fields[1:]}
                for coded in c.encode(block):
                    out["n_tokens"].append(len(coded) // 4)
                    if ids:
                        out["ids"].append(np.frombuffer(coded, "<i4"))
                    if decoded or digests:
                        back = c.decode(coded)
                    if decoded:
                        out["decoded"].append(back)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                cols = [pa.array(v, type=types.get(k, pa.string())) for k, v in out.items()]
                cols.insert(0, batch.column(0).slice(first, len(block)))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))
