"""The pipeline's stages on a small corpus against brute force."""

import random

import numpy as np
import sentencepiece
from brute import contamination, jaccard_groups, repeats, spaced_words

import corpus_pipeline
from bridgerec.llm.queries import vocabulary


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(5)]
    passage = [word() for _ in range(55)]
    texts, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(20, 200))]
        if toxic := i % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["zwonkhead", "quxdolt"]))
        if i % 5 == 1:
            words += passage + [word()]
        if i % 11 == 2:
            words[5:5] = items[i % 5][1].split()
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
        if i % 6 == 3:
            texts[-1] = " ".join(texts[i - 1].split()[:-1])  # nearly the text before
            labels[-1] = (i, 1, labels[i - 1][2])
    return texts, items, labels


def write(spark, folder):
    texts, items, labels = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "sentencepiece"]

    def after(name, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def texts(df):
        assert df.columns == columns
        return {r.doc_id: r.text for r in df.collect()}

    start = {r[0]: r[1] for r in rows}
    clean = after("toxicity", docs)
    assert texts(clean) == {i: t for i, t in start.items() if not any(w in (t or "") for w in ("zwonkhead", "quxdolt"))}

    one = after("ngram_jaccard", clean)
    left = dict(sorted(texts(clean).items()))
    ids = list(left)
    sets, groups = jaccard_groups(list(left.values()))
    want = {ids[k]: left[ids[k]] for k in range(len(ids)) if groups[k] == k or not sets[k]}
    assert texts(one) == want and len(want) < len(left)

    cut = after("suffix_dedup", one)
    got, order = texts(cut), sorted(want)
    for k, (i, (_, later)) in enumerate(zip(order, repeats([want[i] for i in order]), strict=True)):
        words = spaced_words(want[i])
        gone = {p for a, b in later for p in range(a, b)}
        assert spaced_words(got[i]) == [w for p, w in enumerate(words) if p not in gone]
    assert got != want
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    pure = after("decontamination", cut)
    found = contamination(list(got.values()), items)
    keep = {i: t for (i, t), (n, hit, _) in zip(got.items(), found, strict=True) if not (hit and 20 * hit >= n)}
    assert texts(pure) == keep and len(keep) < len(got)

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    coded = after("sentencepiece", pure)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: [1, *sp.encode(t or ""), 2] for i, t in keep.items()}

    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(run.select("doc_id", "ids_sha256").collect()) == sorted(coded.select("doc_id", "ids_sha256").collect())
    assert np.all([r.n_tokens == len(r.ids) for r in run.collect()])
