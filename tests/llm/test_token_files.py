"""Round trip, random access and damage of token files."""

import glob
import os
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from bridgerec.llm.chunk_table import PackedTable
from bridgerec.llm.queries import vocabulary
from bridgerec.llm.token_files import ChunkEncoder, ShardReader, read_token_files, write_token_files

FILE = vocabulary("word_bpe_49k.json")
TEXTS = [
    "The cat's  CAT", None, "", " \n", "naïve ÇA\tx 中文", "<|endoftext|> x<|startoftext|>y", "\x1c \x85a b ΣΑΣ é",
    "word " * 3000, "z" * 4000, "same", "same", "ǅ İ I'll don'T 1234 ½", "J̌ẖ H̱ İ", "x<|EndOfText|>.", "A.B. c., d.. e,f. it's.",
]


def test_encode_is_the_librarys():
    enc, lib = ChunkEncoder(FILE), Tokenizer.from_file(FILE)
    assert enc.by_chunk and enc.width == 2
    for t, coded in zip(TEXTS, enc.encode([(t or "").encode() for t in TEXTS]), strict=True):
        got = np.frombuffer(coded, "<u2").tolist()
        assert got == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_full_table_and_marks_change_no_ids():
    lib = Tokenizer.from_file(FILE)
    words = ["ab", "ab\0", "ab***", "é.", "Ab..,", "abcdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvwx", "x" * 30 + "&&", "a#1$", "!?", "don't!", "<|endoftext|>.", "ab....", "中,"]
    texts = [" ".join(words[k % 7 :: 1 + k % 3]) + f" w{k} {'q' * k}.\n" for k in range(60)]
    for entries in (4, 16, 1000):
        enc = ChunkEncoder(FILE)
        enc.table = PackedTable(entries, "<u2")
        for block in (texts[:20], texts[20:21], texts[20:], texts, texts[::-1]):
            for t, coded in zip(block, enc.encode([x.encode() for x in block]), strict=True):
                assert np.frombuffer(coded, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, (entries, t)
        assert len(enc.table.size) <= entries


def test_table_is_small_and_words_before_marks_are_known():
    enc, asked = ChunkEncoder(FILE), []
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnprst"]
    enc.encode([" ".join(words).encode()])
    held = sum(x.nbytes for x in (enc.table.keys, enc.table.first, enc.table.size, enc.table.met, enc.table.pool))
    assert held < 64 * len(words)  # two objects a word took more
    enc._encode = lambda chunks: asked.extend(chunks) or [b""] * len(chunks)
    enc._encode_words = lambda chunks: asked.extend(chunks) or {}
    enc.encode([" ".join(f"{w}***" for w in words).encode()])
    assert asked == []


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = "file://" + str(tmp_path_factory.mktemp("tokens"))
    ids = [5, 3, 9, None, 12, 7, 1, 30, 22, 40, 40, 2, 50, 51, 52]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS)], "doc_id long, text string, path string")
    return folder, docs, write_token_files(docs, folder, FILE, end_id=1)


def test_round_trip_in_order(spark, written):
    _, docs, manifest = written
    lib = Tokenizer.from_file(FILE)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, d in zip(got, rows, strict=True):
        ids = lib.encode(d.text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (d.doc_id, at, len(ids), crc, ids)
        at += len(ids)


def test_requested_documents_only(written):
    _, _, manifest = written
    assert sorted(r.doc_id for r in read_token_files(manifest, doc_ids=[40, 5, 999]).collect()) == [5, 40, 40]


def test_files_are_plain_zstandard(written):
    folder, _, _ = written
    for path in glob.glob(folder.removeprefix("file://") + "/*.zst"):
        with open(path, "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        shard = ShardReader("file://" + path)
        assert plain == b"".join(shard.frame(i).tobytes() for i in range(len(shard.entries)))
        shard.close()


def test_damage_is_found(written, tmp_path):
    folder, _, _ = written
    path = max(glob.glob(folder.removeprefix("file://") + "/*.zst"), key=os.path.getsize)
    with open(path, "rb") as f:
        data = bytearray(f.read())
    data[ShardReader("file://" + path).offsets[1] - 6] ^= 1
    with open(tmp_path / "bad.zst", "wb") as f:
        f.write(data)
    shard = ShardReader(f"file://{tmp_path}/bad.zst")
    with pytest.raises((ValueError, zstandard.ZstdError)):
        shard.frame(0)
    with open(tmp_path / "cut.zst", "wb") as f:
        f.write(data[:-3])
    with pytest.raises(ValueError):
        ShardReader(f"file://{tmp_path}/cut.zst")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = write_token_files(docs, f"file://{tmp_path}/e", FILE)
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0
