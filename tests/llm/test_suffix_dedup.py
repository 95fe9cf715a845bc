"""Repeated passages against a count of all windows."""

import random

from brute import repeats, spaced_words

from bridgerec.llm import suffix_dedup as sd
from bridgerec.llm.staging import Stage


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    passages = [[word() for _ in range(k)] for k in (49, 50, 51, 60, 84, 85, 140)]
    texts = []
    for _ in range(n):
        parts = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            parts += p if rng.random() < 0.7 else p[rng.randint(0, 20) : rng.randint(40, len(p))]
            parts += [word() for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    return [*texts, texts[0], "la " * 200, "la li " * 70, "la " * 51, "A  " * 49]


def spans(found, name):
    return sorted((r.doc_id, s.start, s.end) for r in found for s in r[name])


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sd.repeated_passages(docs, Stage(spark, "t")).collect()
    want = repeats(texts)
    assert spans(found, "repeated") == sorted((i, *s) for i, (r, _) in enumerate(want) for s in r)
    assert spans(found, "later") == sorted((i, *s) for i, (_, x) in enumerate(want) for s in x)
    return want


def test_random_corpus(spark):
    assert any(later for _, later in check(spark, corpus(3)))


def test_hot_grams_take_the_other_way_to_the_same_windows(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 2)
    check(spark, corpus(4))


def test_drop_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(30000))
    rows = [
        (1, f"Start one.\n{passage}\nEnd ONE.", 0), (2, f"begin two {passage.upper()}  tail two", 1), (3, None, 2), (4, "", 3),
        (5, passage, 4), (None, f"x {passage}", 5), (7, long, 6), (8, " ".join(passage.split()[:49]), 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_key int").withColumnRenamed("doc_key", "later")
    out = sd.drop_repeats(docs, Stage(spark, "t"))
    assert out.columns == docs.columns
    got = {r.later: r.text for r in out.collect()}
    assert got == {0: rows[0][1], 1: "begin two tail two", 2: None, 3: "", 4: "", 5: "x ", 6: long, 7: rows[7][1]}


def test_repeated_rows_and_ids(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage), (1, passage), (2, passage + " a"), (2, passage + " b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(r.text for r in sd.drop_repeats(docs, Stage(spark, "t")).collect())
    assert out == sorted([passage, passage, "a", "b"])
    assert all(len(spaced_words(x)) in (1, 50) for x in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.drop_repeats(docs, Stage(spark, "t")).count() == 0


def test_texts_are_not_read_again_for_common_grams(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string")
    found = sd.repeated_passages(docs, Stage(spark, "t"))
    assert "text#" not in found._jdf.queryExecution().optimizedPlan().toString()
