"""Benchmark decontamination: a prefix-filtered set join of item windows and texts.

A window of an item is ``window`` consecutive words, or the whole item if it has
fewer.  A text holds a window only if it holds all of its words, so for
containment the necessary prefix of a window, with its words ordered by how rare
they are in the texts, is its rarest word.  The join is on this word alone; the
word's place in the window and in the text then fix where the window must begin,
which gives the length and positional bounds, and the words from there on are
compared exactly.

Everything is DataFrame expressions.  The windows are broadcast in blocks of
``BLOCK`` at most, so any number of items works; the texts are never shuffled, only
hits are.  Frequencies are counted over all texts, for the words of items.

Words: A-Z is lower-cased, then runs of characters other than U+0000-U+002F,
U+003A-U+0060 and U+007B-U+007F.

Defined cases: null texts and items have no words; items without words have no
window; rows that agree in id and text share one result and each keeps its row;
equal ids with different texts have results of their own; an item without an id
counts as the empty id; items that share an id count once; an empty table of items
leaves every text clean; an empty table of texts gives an empty table; only the
named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.staging import Stage, fresh_name, maybe_broadcast, row_key

#: Windows (or their words) that one broadcast may hold.
BLOCK = 100_000

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words of a text and a last element that is always empty; the first is
    empty too if the text starts with a break."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(F.concat(low, F.lit(".")), _BREAKS)


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(words, items): the distinct windows and the sorted ids of their items."""
    words = F.filter(_words(F.col(text_col)), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("all"))
    rows = rows.filter(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    rows = rows.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    rows = rows.select("item", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _frequencies(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, n): occurrences in all texts of each word of a window."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    occurring = texts.select(F.explode("words").alias("word"))
    if vocabulary.limit(BLOCK + 1).count() <= BLOCK:
        counts = occurring.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counts = occurring.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    return counts


def _keyed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, offset, words, items, block): each window under its rarest word.
    Windows with a word that stands in no text can't occur and are left out."""
    each = windows.withColumn("key", F.xxhash64("words")).select("key", "words", "items", F.posexplode("words").alias("offset", "word"))
    ranked = each.join(counts, "word").groupBy("key", "words", "items").agg(
        F.count("*").alias("known"), F.min(F.struct("n", "word", "offset")).alias("rare")
    )
    ranked = ranked.filter(F.col("known") == F.size("words"))
    return ranked.select(F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset"), "words", "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    stage: Stage,
    window: int = 13,
    share: tuple[int, int] = (1, 20),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, doc, n_words, n_hit, n_items, items, contaminated)`` for each row.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the
    sorted ids of items with an occurring window.  A text is contaminated if it has
    a hit and den * n_hit >= num * n_words for ``share`` = (num, den).  ``doc``
    stands for the row (a hash of id and text).
    """
    num, den = share
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("doc"), _words(F.col(text_col)).alias("words"))
    windows = stage.write(item_windows(items, window, item_id_col, item_text_col), "windows")
    counts = _frequencies(texts, windows)
    # an even deal of the few windows into blocks of bounded size
    keyed = stage.write(_keyed(windows, counts), "keyed")
    blocks = max(1, -(-keyed.count() // (BLOCK // 2)))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))

    n_words = F.size("words") - 1 - ((F.size("words") > 1) & (F.element_at("words", 1) == "")).cast("int")
    found = None
    for block in range(blocks):
        spans = keyed.filter(F.col("block") == block).select(
            F.col("word").alias("key"), "offset", F.col("words").alias("window"), "items"
        )
        # the empty element that ends each text leaves one row a text
        end = spans.sparkSession.range(1).select(
            F.lit("").alias("key"), F.lit(None).cast("int").alias("offset"),
            F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"),
        )
        table = F.broadcast(spans.unionAll(end) if block == 0 else spans)
        places = texts.select("id", "doc", "words", F.posexplode("words").alias("pos", "word"))
        begin, size = F.col("pos") - F.col("offset"), F.size("window")
        held = (
            (begin >= 0)
            & (begin + size < F.size("words"))
            & (F.get("words", begin) == F.get("window", F.lit(0)))
            & (F.slice("words", begin + 1, size) == F.col("window"))
        )
        last = F.col("window").isNull() & (F.col("pos") == F.size("words") - 1)
        hits = places.join(table, (F.col("word") == F.col("key")) & F.coalesce(held, last))
        hits = hits.select("id", "doc", n_words.alias("n_words"), begin.alias("begin"), size.alias("size"), "items")
        found = hits if found is None else found.unionAll(hits)
    found = stage.write(found, "found")

    spans = F.array_sort(F.collect_set(F.struct("begin", "size")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["begin"] + x["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["begin"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    hit = found.filter("begin is not null").groupBy("doc").agg(spans.alias("spans"), F.collect_set("items").alias("lists"))
    hit = hit.select(
        "doc",
        F.aggregate("spans", start, add, lambda acc: acc["n"]).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"),
    )
    rows = found.filter("begin is null").select("id", "doc", F.col("n_words").cast("long").alias("n_words"))
    out = rows.join(hit, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "doc",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (den * n_hit >= num * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they were."""
    bad = contamination(docs, items, stage, id_col=id_col, text_col=text_col, **options)
    key = fresh_name(docs, "doc_key")
    bad = stage.write(bad.filter("contaminated").select(F.col("doc").alias(key)).distinct(), "bad")
    return docs.withColumn(key, row_key(id_col, text_col)).join(maybe_broadcast(bad), key, "left_anti").drop(key)
