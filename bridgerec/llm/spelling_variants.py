"""Spelling variants: words one edit apart, found by search schemes on FM-indexes.

Words are counted over all documents, each task combining its counts before the shuffle.
Of two words that differ by one code point, the left or the right half of the first
stands unchanged in the second.  A search scheme therefore matches one half exactly and extends
across the other, allowing one error: left half first, to the right, on an index of the reversed
words; right half first, to the left, on an index of the words.  The two indexes
are the two directions of a bidirectional FM-index over the delimited vocabulary; a search
starts at a delimiter and goes one way, so it needs the suffix ranks of one of them.  A pair
that both schemes can find is reported by the first alone.

Every half has at least ``min_chars // 2`` code points, so a word need only meet those that begin (or
end) with the same so many: the vocabulary is dealt by these two keys, and a task
indexes and searches ``CHUNK`` words at a time.  A key of more than ``BLOCK`` words is dealt in blocks: a word
is indexed in one and sought in all of them.  No pairs leave a task: a word's near words are counted
there and the best of them kept.

Defined cases: null texts have no words; a null id is an empty string in the damage key;
words of 10**7 code points are words like any others; a word without near words has a
null form, no near words and is its own root; an empty table, or one without words that
occur often enough, gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.blocks import text_blocks, whole_groups
from bridgerec.llm.staging import Stage, shuffle_partitions

#: Letters of a run: ASCII and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: One of so many runs of a document loses a code point.
DAMAGED = 199
#: Words of an index, words of a key that are indexed together, and words sought at once.
CHUNK, BLOCK, SOUGHT = 60_000, 40_000, 8_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Forms lead to words five times as frequent, so chains are short; more rounds mean a fault.
MAX_ROUNDS = 40


def word_counts(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: lower-cased runs of letters with at least ``min_chars`` code points, after the damage."""
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, block in text_blocks(batch.column(1)):
                for k, text in enumerate(block):
                    here = Counter(runs.findall(text.lower().decode()))
                    start = zlib.crc32(f"{'' if ids[a + k] is None else ids[a + k]}:".encode())
                    for word, n in here.items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % DAMAGED:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1 :]
                            if len(word) < min_chars:
                                continue
                        total[word] += n
                    if len(total) >= COUNTED:
                        yield counted(total)
                        total = Counter()
        yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class FMIndex:
    """Backward search over words that each end in a delimiter, code 0.

    A row is a suffix of a word, the bare delimiter included; rows are in suffix order, equal
    suffixes in the order of their words.  ``flat[starts[i] : starts[i + 1]]`` are the codes of word i
    *from its end to its beginning*, the order in which a search meets them."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, letters: int):
        self.letters = letters
        sizes = np.diff(starts)
        rows = int(len(flat) + len(sizes))
        base = starts[:-1] + np.arange(len(sizes))  # the bare delimiter of each word
        depth = np.arange(rows) - np.repeat(base, sizes + 1)
        first = np.zeros(rows, np.int64)  # a suffix's first code: the last one the search has met
        first[depth > 0] = flat
        rank, known, longest = first, 1, int(sizes.max(initial=0)) + 1
        while known < longest:  # prefix doubling: order by twice as many codes
            rest = np.zeros(rows, np.int64)
            deep = np.flatnonzero(depth >= known)
            rest[deep] = rank[deep - known]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rest, return_inverse=True)
            known *= 2
        order = np.argsort(rank, kind="stable")
        before = np.zeros(rows, np.int64)  # the code before a suffix, 0 before a whole word
        before[:-1][depth[1:] > 0] = first[1:][depth[1:] > 0]
        self.bwt = before[order]
        self.rows = rows
        self.words = len(sizes)
        self.keys = np.sort(self.bwt * rows + np.arange(rows))
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.whole = word[order[self.bwt == 0]]

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes with ``code`` before those of rows [lo, hi): the number of
        smaller codes in the transform plus the code's rank, which one search gives."""
        at = code * self.rows
        return np.searchsorted(self.keys, at + lo), np.searchsorted(self.keys, at + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which, code, lo, hi) of every code that stands before some of the rows [lo, hi)."""
        small = hi - lo <= self.letters
        few, many = np.flatnonzero(small), np.flatnonzero(~small)
        sizes = (hi - lo)[few]
        which = np.repeat(few, sizes)
        row = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]
        both = np.unique(which * (self.letters + 1) + self.bwt[row])
        every = (many[:, None] * (self.letters + 1) + np.arange(1, self.letters + 1)).ravel()
        both = np.concatenate([both[both % (self.letters + 1) != 0], every])
        which, code = both // (self.letters + 1), both % (self.letters + 1)
        a, b = self.extend(code, lo[which], hi[which])
        keep = a < b
        which, code, a, b = which[keep], code[keep], a[keep], b[keep]
        by = np.argsort(which, kind="stable")
        return which[by], code[by], a[by], b[by]

    def one_error(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for words one edit from a query whose first ``exact`` codes, as the
        search meets them, stay; query i is ``flat[at[i] : at[i] + size[i]]``."""
        found: list[np.ndarray] = []
        q = np.arange(len(at))
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.words)
        for t in range(int(size.max(initial=0)) + 1):
            if not len(q):
                break
            b = exact[q] <= t
            if b.any():
                found.append(self._finish(flat, at, size, *self._branches(flat, at, size, exact, t, q[b], lo[b], hi[b])))
            on = t < size[q]
            q, lo, hi = q[on], lo[on], hi[on]
            lo, hi = self.extend(flat[at[q] + t], lo, hi)
            alive = lo < hi
            q, lo, hi = q[alive], lo[alive], hi[alive]
        both = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return both // self.words, both % self.words

    def _branches(self, flat, at, size, exact, t, q, lo, hi) -> tuple[np.ndarray, ...]:
        """(query, lo, hi, next place) after an error at place t."""
        inside = t < size[q]
        code = np.where(inside, flat[np.minimum(at[q] + t, len(flat) - 1)], -1)
        nodes, node = np.unique(lo, return_inverse=True)  # queries alike so far share their rows
        top = np.zeros(len(nodes), np.int64)
        top[node] = hi
        which, child, a, b = self.children(nodes, top)
        begins = np.searchsorted(which, np.arange(len(nodes) + 1))
        n = np.diff(begins)[node]
        one = np.repeat(np.arange(len(q)), n)
        pick = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + begins[node][one]
        other = child[pick] != code[one]  # putting a letter before its like is putting it after
        one, pick = one[other], pick[other]
        swap = inside[one]
        # dropping a letter after its like is dropping that one
        drop = inside & ~((t > exact[q]) & (code == flat[np.maximum(at[q] + t - 1, 0)]))
        parts = [
            (q[one], a[pick], b[pick], np.full(len(one), t)),
            (q[one[swap]], a[pick[swap]], b[pick[swap]], np.full(int(swap.sum()), t + 1)),
            (q[drop], lo[drop], hi[drop], np.full(int(drop.sum()), t + 1)),
        ]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _finish(self, flat, at, size, q, lo, hi, place) -> np.ndarray:
        """query * words + word for the whole words that the rest of the query leads to."""
        found = [np.empty(0, np.int64)]
        while len(q):
            ends = place == size[q]
            if ends.any():
                a, b = self.extend(np.zeros(int(ends.sum()), np.int64), lo[ends], hi[ends])
                n = b - a
                row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                found.append(np.repeat(q[ends], n) * self.words + self.whole[row])
            q, lo, hi, place = (x[~ends] for x in (q, lo, hi, place))
            lo, hi = self.extend(flat[at[q] + place], lo, hi)
            alive = lo < hi
            q, lo, hi, place = q[alive], lo[alive], hi[alive], place[alive] + 1
        return np.concatenate(found)


def near_words(words: list[str], group: np.ndarray, indexed: np.ndarray, right_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): places in ``words`` of indexed words of the query's group that are one
    edit from it and that this scheme reports."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    alphabet, flat = np.unique(points, return_inverse=True)
    flat = flat.astype(np.int64) + 1
    left = size // 2
    if right_first:  # the codes in the order in which the search meets them
        place = np.arange(len(flat)) - np.repeat(ends - size, size)
        flat, exact = flat[np.repeat(ends, size) - 1 - place], size - left
    else:
        exact = left
    at = ends - size
    chosen = np.flatnonzero(indexed)
    some = flat[np.repeat(indexed, size)]
    index = FMIndex(some, np.append(0, np.cumsum(size[chosen])), len(alphabet))
    pairs = []
    for a in range(0, len(words), SOUGHT):
        q, w = index.one_error(flat, at[a : a + SOUGHT], size[a : a + SOUGHT], exact[a : a + SOUGHT])
        pairs.append(np.stack([q + a, chosen[w]]))
    query, word = np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1)
    keep = group[query] == group[word]
    if right_first:  # words that begin with the query's left half were reported by the other scheme
        alike = np.ones(len(query), bool)
        for k in range(int(left.max(initial=0))):
            both = np.flatnonzero(alike & (k < left[query]))
            x, y = query[both], word[both]
            alike[both] = flat[ends[x] - 1 - k] == flat[ends[y] - 1 - k]
        keep &= ~alike
    return query[keep], word[keep]


def _best(table: pa.Table) -> pa.RecordBatch:
    """(word, n, n_near, best) of each row of (side, group, indexed, word, n); ``best`` is
    the near word of largest n, the smallest of them, with its n negated."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    q, w = near_words(words, table.column("group").to_numpy(), table.column("indexed").to_numpy(zero_copy_only=False), table.column("side")[0].as_py() == 1)
    count = np.bincount(q, minlength=len(words))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((rank[w], -n[w], q))
    first = by[np.append(True, q[by][1:] != q[by][:-1])] if len(by) else by
    best = np.full(len(words), -1)
    best[q[first]] = w[first]
    none = best < 0
    cols = [
        table.column("word").combine_chunks(),
        pa.array(n),
        pa.array(count, pa.int64()),
        pa.array(-n[best], mask=none),
        pa.array([None if k < 0 else words[k] for k in best.tolist()], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["word", "n", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups (side, group), many to an index."""
    held: list[pa.Table] = []
    rows = 0
    for table, cuts in whole_groups(batches, 2):
        side = table.column("side").to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and (rows + b - a > CHUNK or held[0].column("side")[0].as_py() != side[a]):
                yield _best(pa.concat_tables(held).combine_chunks())
                held, rows = [], 0
            held.append(table.slice(a, b - a))
            rows += b - a
    if held:
        yield _best(pa.concat_tables(held).combine_chunks())


def _dealt(words: DataFrame, stage: Stage, key_chars: int) -> DataFrame:
    """``(side, group, indexed, word, n)``: every word under its first and its last letters."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", 1, key_chars).alias("key")),
        F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {key_chars})").alias("key")),
    )
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("s.side", "s.key", "word", "n")
    large = rows.groupBy("side", "key").count().filter(F.col("count") > BLOCK)
    large = large.select(F.col("side").alias("s"), F.col("key").alias("k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # a row for every BLOCK words of the vocabulary at most: a few bytes each
    rows = rows.join(F.broadcast(stage.write(large, "large")), (F.col("side") == F.col("s")) & (F.col("key") == F.col("k")), "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")) == F.col("block")
    return rows.select("side", F.xxhash64("key", "block").alias("group"), own.alias("indexed"), "word", "n")


def spelling_variants(
    docs: DataFrame,
    stage: Stage,
    min_chars: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word with at least ``min_chars`` code
    points and ``min_count`` occurrences.  ``form`` is the most frequent word one edit away, if it
    occurs at least ``ratio`` times as often; ``root`` is where forms lead."""
    if min_chars < 2 or ratio < 2:
        raise ValueError("min_chars and ratio are 2 at least")
    words = stage.write(word_counts(docs, min_chars, id_col, text_col).filter(F.col("n") >= min_count), "words")
    parts = shuffle_partitions(docs.sparkSession)
    dealt = _dealt(words, stage, min_chars // 2).repartition(parts, "side", "group").sortWithinPartitions("side", "group")
    near = dealt.mapInArrow(_searched, "word string, n long, n_near long, best_n long, best string")
    best = F.when(F.col("best").isNotNull(), F.struct("best_n", "best"))
    found = near.groupBy("word").agg(F.max("n").alias("n"), F.min(best).alias("best"), F.sum("n_near").alias("n_near"))
    is_form = -F.col("best.best_n") >= ratio * F.col("n")
    found = found.select(
        "word",
        F.when(is_form, F.col("best.best")).alias("form"),
        "n",
        F.col("n_near"),
        F.when(is_form, -F.col("best.best_n")).alias("form_n"),
    )
    found = stage.write(found, "found")
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("root")), stage)
    joined = found.join(roots.toDF("w", "root"), F.col("word") == F.col("w"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, stage: Stage) -> DataFrame:
    """``links(word, root)`` with each root followed to its end, in steps that double."""
    now = stage.write(links, "roots-0")
    for k in range(1, MAX_ROUNDS):
        onward = now.toDF("at", "onward")
        step = now.join(onward, F.col("root") == F.col("at"), "left")
        new = stage.write(step.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), f"roots-{k}")
        done = new.filter("moved").isEmpty()
        now = new.select("word", "root")
        if done:
            return now
    raise RuntimeError("forms do not end")
