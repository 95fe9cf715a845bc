"""Contamination against a look-up of every window."""

import random

from brute import contamination as brute

from bridgerec.llm import decontaminate as dc
from bridgerec.llm.staging import Stage


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    got = dc.contamination(docs, bench, Stage(spark, "t")).collect()
    want = brute(texts, items)
    assert len(got) == len(texts)
    for r in got:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items, r.n_items) == (n, hit, ids, len(ids))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    clean = {i for i, (n, hit, _) in enumerate(want) if not (hit and 20 * hit >= n)}
    out = dc.drop_contaminated(docs, bench, Stage(spark, "t"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == clean


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcÉé9", k=rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 5, 13, 14, 40])))) for k in range(12)]
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(rng.choice([0, 5, 30, 300]))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w) - 1)
            at = rng.randint(0, len(parts))
            parts[at:at] = w if rng.random() < 0.6 else w[a : a + rng.randint(10, 20)]
        texts.append(rng.choice([" ", ", ", "-"]).join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    return texts, items


def test_random_corpus(spark):
    check(spark, *corpus(5))


def test_blocks_of_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 20)
    check(spark, *corpus(6))


def test_edges(spark):
    thirteen = " ".join(f"w{i}" for i in range(13))
    items = [(1, thirteen), (2, thirteen + " more"), (3, "short item"), (4, None), (5, "...!"), (3, "another SHORT one"), (None, "no id")]
    texts = [
        None, "", "...", thirteen, "." + thirteen.replace(" ", ".") + ".", "short, item", "a short item " + "z " * 60,
        "z " * 37 + "short item", "z " * 38 + "short item", "another short one", "x no-id y", " ".join(["w0"] * 5000) + " " + thirteen,
    ]
    docs = [(i, t) for i, t in items if i is not None]
    check(spark, texts, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = spark.createDataFrame([(7, "x no-id y"), (7, "x no-id y"), (None, thirteen)], "doc_id long, text string")
    got = dc.contamination(one, bench, Stage(spark, "t")).collect()
    assert sorted((str(r.doc_id), tuple(r["items"]), r.contaminated) for r in got) == [
        ("7", ("",), True), ("7", ("",), True), ("None", ("1", "2"), True),
    ]


def test_no_items_and_no_texts(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = dc.contamination(docs, none, Stage(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert dc.contamination(docs.limit(0), none, Stage(spark, "t")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = dc.contamination(docs, items, Stage(spark, "t"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
