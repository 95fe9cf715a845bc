"""The chunk codec against the library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from bridgerec.llm.queries import vocabulary
from bridgerec.llm.sentencepiece_codec import ChunkCodec, sentencepiece_codec

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "▁x ▁▁y", "x\ny\t z", "\x00", "naïve Ünïcode 中文 🙂",
    "<s> </s> <unk> <0x41>", "w" * 3000, "word " * 2000, " " * 100, "é", "a b　c",
]


def test_encode_is_the_librarys(sp):
    codec = ChunkCodec(MODEL)
    assert codec.by_chunk
    rng = random.Random(2)
    more = ["".join(rng.choices("ab ▁é\n.T", k=rng.randint(1, 40))) for _ in range(500)]
    for text in TEXTS + more:
        ids = np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist()
        assert ids == [sp.bos_id(), *sp.encode(text), sp.eos_id()], repr(text)
        assert codec.decode(codec.encode([text.encode()])[0]) == sp.decode(ids)


def test_small_table_drops_entries_without_change(sp):
    codec = ChunkCodec(MODEL)
    codec.table.entries = 3
    for text in ["a b c d e f g", "a b x", "q r s t a", "a b c d e f g", "w" * 300 + " a"] * 2:
        assert np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist()[1:-1] == sp.encode(text)


def test_frame(spark, sp):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(None, "null id", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentencepiece_codec(docs, MODEL, digests=True).collect()
    assert len(got) == len(rows)
    want = set()
    for i, t, _ in rows:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        back = sp.decode(ids)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.add((i, len(ids), tuple(ids), back, sha, hashlib.sha256(back.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert sentencepiece_codec(docs.limit(0), MODEL).count() == 0


def test_tasks_without_a_table_empty_the_worker_of_earlier_ones():
    """What toxicity's tasks left in a worker is not held while n-gram Jaccard runs there."""
    import numpy as np
    import pyarrow as pa

    from bridgerec.llm import ngram_jaccard as NJ
    from bridgerec.llm.chunk_table import ChunkTable

    class Docs:  # runs a task of the function in this process
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"]), pa.array([7])], names=["id", "text", "doc"])
            return list(run(iter([batch])))

        def select(self, *_):
            return type("Texts", (), {"mapInArrow": lambda _, run, schema: list(run(iter([pa.RecordBatch.from_arrays([pa.array(["a b c d e f"])], names=["text"])])))})()

    for task in (lambda: NJ._sets(Docs(), 5), lambda: NJ._postings(Docs(), 5, np.zeros(1 << NJ.SKETCH_BITS, np.uint8), 3, 4)):
        table = ChunkTable(lambda chunks: [len(c) for c in chunks])
        assert list(table.values([[b"ab", b"c"]])) == [[2, 1]] and table.young
        task()
        assert not table.young and ChunkTable.in_use is None
        assert list(table.values([[b"ab", b"c"]])) == [[2, 1]]
