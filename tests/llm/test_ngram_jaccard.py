"""The n-gram Jaccard join against all pairs of small inputs."""

import random

import numpy as np
import pytest
from brute import jaccard_groups
from pyspark.sql import functions as F

from bridgerec.llm import ngram_jaccard as nj
from bridgerec.llm.staging import Stage


def corpus(seed, groups=25):
    """Texts in groups of edited copies, with a passage and a line that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    shared, line = [word() for _ in range(60)], [word() for _ in range(9)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 150, 700]))]
        if rng.random() < 0.4:
            base += shared
        if rng.random() < 0.5:
            base = base[:10] + line + base[10:]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 12])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy = copy[: max(1, len(copy) * 4 // 5)]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = nj.ngram_jaccard_join(docs, Stage(spark, "t")).collect()
    sets, groups = jaccard_groups(texts)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), g) for i, g in enumerate(groups)}
    assert len(got) == len(texts)
    return groups


def test_random_corpus(spark):
    groups = check(spark, corpus(1))
    assert len(set(groups)) < len(groups)


def test_tiles_are_cut_without_change(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 2)
    check(spark, corpus(2, groups=12))


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(8):  # neighbours link, ends do not
        texts.append(" ".join(words[k * 12 : k * 12 + 120]))
    groups = check(spark, texts[::-1])
    assert len(set(groups)) == 1


def test_edge_cases(spark):
    long = " ".join(f"x{i % 977}" for i in range(20000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE Two"), (6, "one  two three"), (7, long), (8, long + " y"),
        (None, "one two"), (None, "a b c d e f g"), (9, "a b c d e f g"), (9, "a b c d e f g"), (9, "other text entirely here now"),
    ]
    docs = spark.createDataFrame([(*r, "c", 0) for r in rows], "doc_id long, text string, class string, n int")
    got = nj.ngram_jaccard_join(docs, Stage(spark, "t"))
    found = sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    want = [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 4), (None, 3, 9), (9, 3, 9), (9, 3, 9), (9, 1, 9),
    ]
    assert [f for f in found if f[0] not in (7, 8)] == sorted(want, key=str)
    assert {f[2] for f in found if f[0] in (7, 8)} == {7}
    kept = nj.drop_near_duplicates(docs, Stage(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([
        ("1", ""), ("2", ""), ("3", " \t\n"), ("4", "one two"), ("6", "one  two three"), ("7", long), ("9", "a b c d e f g"),
        ("9", "other text entirely here now"),
    ])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_jaccard_join(docs, Stage(spark, "t")).count() == 0
    assert nj.drop_near_duplicates(docs, Stage(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [1, 4, 7, 100, 3000])
def test_bitmaps_bound_the_overlap(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, rng.integers(1, n + 1)).astype(np.uint64)]))
        x, y = (np.frombuffer(nj.bitmap(s), np.uint64)[None] for s in (a, b))
        least = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(nj.folded(x, least) ^ nj.folded(y, least)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_copies_in_several_batches_count_once(spark):
    p, b, x, c, d, y, e, q = range(1, 9)  # b and c may link; each class between p and q has two copies
    lists = {10: [p, b, b, x, x, c, c, q], 20: [p, d, d, y, y, e, e, q]}
    rows = [(token, cls, (100 << 32) + (3 if token == 10 else 0)) for token, members in lists.items() for cls in members]
    shared = nj._shared(spark.createDataFrame(rows, "token long, class long, place long"), 3, 4)
    assert sorted((r.token, r["class"]) for r in shared.collect()) == sorted((t, m) for t in lists for m in set(lists[t]))
    rng = np.random.default_rng(1)
    maps = {cls: rng.bytes(128) for cls in range(1, 9)}
    maps[c] = maps[b]
    light = spark.createDataFrame([(k, bytearray(v)) for k, v in maps.items()], "class long, bitmap binary")
    labelled = shared.select("token", "class", "place").withColumn("component", F.col("class"))
    got = {(r.a, r.b) for r in nj._tiles(labelled, light, 3, 4, False).collect()}
    assert (b, c) in got


@pytest.mark.parametrize("n", [300, 1000, 1900, 3900, 7500, 15000, 19000, 100000])
def test_tiles_tell_disjoint_sets_apart(n):
    rng = np.random.default_rng(n)
    x, y = (np.frombuffer(nj.tile_bitmap(nj.bitmap(rng.integers(0, 1 << 63, n).astype(np.uint64))), np.uint64)[None] for _ in range(2))
    assert not nj._may_link(x ^ y, np.array([2 * n]), 3, 4).any()


def test_closest_hands_on_at_most_a_pair_a_row(spark):
    members = 60
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in range(1, members + 1)]
    light = spark.createDataFrame([(k, bytearray(nj.bitmap(s))) for k, s in enumerate(sets)], "class long, bitmap binary")
    lists = spark.createDataFrame([(9, k, len(s) << 32, k) for k, s in enumerate(sets)], "token long, class long, place long, component long")
    rows = nj._tiles(lists, light, 3, 4, True).collect()
    assert 0 < sum(r.token is None for r in rows) < members
    assert [r.token for r in rows if r.token is not None] == [9]
    assert sum(r.token is None for r in nj._tiles(lists, light, 3, 4, False).collect()) > 10 * members
