"""Toxicity and quality: kernels, tables, folds, held-out accuracy and edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgerec.llm import quality as ql
from bridgerec.llm import queries
from bridgerec.llm import toxicity as tx
from bridgerec.llm.labels import labelled_sample
from bridgerec.llm.staging import Stage

SF = "/root/testdata/sf0.01"


def slow_kernel(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), tx.ORDER):
        for j in itertools.combinations(range(len(t)), tx.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += tx.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_all_subsequences():
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 7))), "".join(rng.choices("abc", k=rng.randint(0, 7)))) for _ in range(60)]
    got = tx.kernel(tx._points([a for a, _ in pairs], 7), tx._points([b for _, b in pairs], 7))
    assert np.allclose(got, [slow_kernel(a, b) for a, b in pairs])


def test_words_and_runs_of_letters():
    assert b"idiot" in tx.words_of(b"you I d i o t !")
    assert tx.plain(b"i.d-i_o.t!") == "idiot"
    marks = tx.Landmarks(("idiot", "moron"))
    words = ["idiot", tx.plain(b"i.d.i.o.t"), "aidiotb", "idxiot", "x" * 500 + "idiot" + "y" * 99, "", "station"]
    value = marks.values(words)
    assert value[[0, 1, 2, 4], 0] == pytest.approx(1) and value[3, 0] > 0.3 and value[[5, 6], 0].max() < 0.1
    assert (value > 0).sum(axis=1).max() == 1  # the nearest landmark alone


@pytest.fixture(scope="module")
def planted(spark):
    """Invented prose; a third of the labelled texts hold an insult, some of them spelled with gaps."""
    rng = random.Random(5)
    parts = ["an", "the", "er", "ing", "ou", "ha", "st", "re", "on", "ly"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.33
        if toxic:
            bad = rng.choice(["blockhead", "numskull", "dimwit", "lowbrow" + word()])
            if i % 7 == 0:
                bad = rng.choice([".", "-"]).join(bad)
            words.insert(rng.randint(0, len(words)), bad)
        rows.append((i, " ".join(words), "en" if toxic else "de", i))
        labels.append((i, int(toxic), int(not toxic), 1))
    rows += [(2000, None, "en", 0), (2001, "", "en", 0), (None, "dimwit " * 3000, "en", 0), (2002, "the dimwit", "x", 1), (2002, "the dimwit", "x", 1)]
    labels += [(5000, 1, 1, 1), (3, None, None, 1), (None, 1, 0, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, label long"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text int"),
        {x[0]: x[1] for x in labels[:900]},
    )


def test_toxicity_on_planted_texts(spark, planted):
    docs, labels, truth = planted
    model = tx.fit_toxicity(docs, labels, Stage(spark, "t"))
    got = tx.toxicity_scores(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[None].held_out is False and by[2000].score == by[2001].score and by[2001].predicted == 0
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_insults_of_a_rare_language_are_met(spark):
    rng = random.Random(7)
    common, rare = ["an", "the", "er", "ing", "ou", "ha", "st", "re", "on", "ly"], ["zu", "kja", "mo", "vik", "pe", "dro", "lu", "fni"]
    word = lambda parts: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    rows, labels, mine = [], [], []
    for i in range(5000):
        foreign, toxic = i % 100 == 1, i % 4 == 1  # a hundredth of all, one of 25 toxic ones
        foreign, toxic = foreign or i % 50 == 2, toxic and (not foreign or i % 400 == 1)
        words = [word(rare if foreign else common) for _ in range(rng.randint(8, 30))]
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["grobuk", "grobel"]) if foreign else rng.choice(["blockhead", "numskull", "dimwit", "lowbrow"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
        mine += [i] if foreign and toxic else []
    assert len(mine) < 0.02 * sum(y for _, y in labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), Stage(spark, "t"))
    assert any("grobuk".startswith(x[:4]) for x in model.strings)
    got = {r.doc_id: r.predicted for r in tx.toxicity_scores(docs, model).collect()}
    assert all(got[i] for i in mine)
    assert np.mean([got[i] == y for i, y in labels]) > 0.99


def test_near_copies_count_once(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for _ in range(5):
        base = [word() for _ in range(100)]
        for k in range(8):  # a word at another place is new, and one more begins some copies
            rows.append((" ".join(["more"] * (k % 2) + base[: k * 10] + [word()] + base[k * 10 :]), 1))
    got = tx._unlike(spark.createDataFrame(rows, "text string, label int")).collect()
    assert len(got) == 5


def test_share_without_landmarks_is_of_all_labels(spark):
    # the clean copies stay as one text of the sample
    rows = [(i, "same words all over") for i in range(60)] + [(100 + i, f"word{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i >= 100)) for i, _ in rows]
    model = tx.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), Stage(spark, "t"))
    known = [y for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    assert model.strings == () and model.scores([b"x"])[0] == pytest.approx((sum(known) + 1) / (len(known) + 2))


def test_held_out_labels_are_never_read(spark, planted):
    docs, labels, _ = planted
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned = turned.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert tx.fit_toxicity(docs, labels, Stage(spark, "t")) == tx.fit_toxicity(docs, turned, Stage(spark, "t"))
    x = ql.column_features(docs.limit(50).toArrow()["text"].combine_chunks())
    one, two = (ql.fit_quality(docs, y, Stage(spark, "t")).scores(x) for y in (labels, turned))
    assert (one == two).all()


@pytest.mark.parametrize("only", [0, 1, None])
def test_labels_of_one_class_or_none(spark, planted, only):
    docs, labels, _ = planted
    some = labels.filter(F.lit(False) if only is None else F.col("toxic") == only)
    got = tx.toxicity_scores(docs, tx.fit_toxicity(docs, some, Stage(spark, "t"))).select("score").distinct().collect()
    assert [round(r[0], 6) for r in got] == [float(only or 0)]
    some = labels.filter(F.lit(False) if only is None else F.col("quality") == only)
    got = ql.quality_scores(docs, ql.fit_quality(docs, some, Stage(spark, "t"))).select("score").distinct().collect()
    assert [round(r[0], 6) for r in got] == [float(only or 0)]


def test_empty_documents_table(spark, planted):
    docs, labels, _ = planted
    none = docs.limit(0)
    assert tx.toxicity_scores(none, tx.fit_toxicity(none, labels, Stage(spark, "t"))).count() == 0
    assert ql.quality_scores(none, ql.fit_quality(none, labels, Stage(spark, "t"))).count() == 0


def test_sample_is_bounded(spark, planted):
    docs, labels, _ = planted
    got = labelled_sample(docs, labels, "toxic", 10).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 10, 1: 10}


def test_features_do_not_depend_on_the_block():
    import pyarrow as pa

    texts = ["A b. C!", "", None, "x" * 3000, "one two  two\n\nthree | four 123 é", "word " * 5000]
    whole = ql.column_features(pa.array(texts))
    alone = np.concatenate([ql.column_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all() and (whole[1] == 0).all() and (whole[2] == 0).all()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = ql.fit_additive(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.95


@pytest.mark.parametrize("name, label", [("op7_toxicity", "toxic"), ("op10_quality", "quality")])
def test_queries_on_the_given_tables(spark, name, label):
    labels = {r.doc_id: r[label] for r in queries.table(spark, SF, "labels").collect()}
    got = getattr(queries, name)(spark, SF).collect()
    assert len(got) == queries.table(spark, SF, "documents").count()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = ([s for s, y in held if y == c] for c in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > (0.8 if label == "toxic" else 0.95), auc


def test_toxic_texts_of_every_language_are_met(spark):
    folder = "/root/testdata/sf0.1"
    docs = queries.table(spark, folder, "documents")
    known = {r.doc_id: (r.lang, r.toxic) for r in docs.join(queries.table(spark, folder, "labels"), "doc_id").select("doc_id", "lang", "toxic").collect()}
    got = [(*known[r.doc_id], r.predicted) for r in queries.op7_toxicity(spark, folder).collect() if r.held_out and r.doc_id in known]
    for lang in ("en", "de", "fr", "es"):
        toxic = [p for x, y, p in got if x == lang and y == 1]
        assert np.mean(toxic) >= 0.85, (lang, toxic)
        clean = [p for x, y, p in got if x == lang and y == 0]
        assert np.mean(clean) <= 0.03, (lang, sum(clean), len(clean))
    assert np.mean([p for _, y, p in got if y == 0]) <= 0.01


def test_words_that_tell_by_their_number(spark):
    rng = random.Random(11)
    parts = ["an", "the", "er", "ing", "ou", "ha", "st", "re", "on", "ly"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(100, 300))]
        toxic = i % 3 == 0
        for _ in range(rng.randint(4, 7) if toxic else rng.random() < 0.1):
            words.insert(rng.randint(0, len(words)), "kvorlich" + word())
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), Stage(spark, "t"))
    got = {r.doc_id: r.predicted for r in tx.toxicity_scores(docs, model).collect()}
    assert np.mean([got[i] == y for i, y in labels]) > 0.98


def test_nearest_is_the_same_in_slices(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdr", k=rng.randint(0, 50))) for _ in range(400)]
    marks = tx.Landmarks(("abra", "cadabra", "dab"))
    whole = marks.nearest(words)
    monkeypatch.setattr(tx, "SLICE", 7)
    monkeypatch.setattr(tx, "STRETCHES", 5)
    for a, b in zip(whole, marks.nearest(words), strict=True):
        assert np.allclose(a, b)
    for w, j, v in zip(words, whole[0], whole[1], strict=True):  # the largest value of any stretch
        alone = max((x for m in range(3) for x in [tx.Landmarks((marks.strings[m],)).values([w])[0, 0]]), default=0)
        assert np.isclose(v, alone) and (j >= 0) == (alone > 0)


def test_kernel_of_strings_with_little_room():
    rng = random.Random(3)
    for width in (2, 3, 4, 9):  # cells with no room for the letters before or behind are not computed
        pairs = [tuple("".join(rng.choices("abc", k=rng.randint(1, k))) for k in (width, 6)) for _ in range(40)]
        got = tx.kernel(tx._points([a for a, _ in pairs], width), tx._points([b for _, b in pairs], 6))
        assert np.allclose(got, [slow_kernel(a, b) for a, b in pairs], rtol=1e-12, atol=0)


def test_kernel_matrix_holds_a_part_of_the_pairs_at_a_time(monkeypatch):
    most, whole = [], tx.kernel
    monkeypatch.setattr(tx, "kernel", lambda s, t: most.append(len(s)) or whole(s, t))
    marks = tx.Landmarks(tuple(f"{a}{b}cde" for a in "abcdefghijk" for b in "abcdefghijk"))
    assert np.allclose(np.diag(marks.matrix()), 1)
    assert max(most) <= tx.STRETCHES < len(marks.strings) * (len(marks.strings) + 1) // 2
