"""Toxicity by a support vector machine over gapped subsequences.

Two strings are compared by the subsequence kernel of Lodhi et al. (Text
Classification using String Kernels, 2002): all common subsequences of ``ORDER``
letters, each weighted by ``DECAY`` to the power of the letters it spans, so letters
that are inserted into an insult, or replaced, lower the value but do not remove it.

Landmarks are all strings of 4 to 8 letters that begin words of toxic texts far more
often than of others: more than four times as often, and so much that chance would make
less than a tenth of such a string among all that are tested.  Neither their number nor
their share is bounded, so a rare language's insults are landmarks too.  A word's value for a
landmark is the largest normalised kernel between the landmark and a stretch of the word as long
or one letter longer; a run of single letters counts as a word, and what is neither letter nor
digit is dropped, so spelled-out words are met too.  A word and a landmark that have too few
letter pairs in common count as 0, and only a word's nearest landmark counts.  Values are whitened by
the inverse root of the landmarks' own kernel matrix (Nyström), and squared-hinge linear
machines are fitted to them:

* a machine of texts, on the mean over a text's words of the values of the words' beginnings
  (a kernel between whole texts and landmarks): words that are no insults alone tell a toxic text by their number;
* a machine of words: a text has the margin of its worst word, so one insult in a long text
  counts as in a short one.  Only texts have labels: training alternates between picking the worst
  word of each toxic text, and the worst words of clean ones, and fitting the machine to them
  (multiple-instance learning, Andrews et al., 2002); the landmarks that no tenth of the clean texts
  has, and these with a letter inserted, are further toxic examples.

Each margin is turned into a probability by a logistic fit; the larger one is the score.

Defined cases: null, empty and wordless texts have all values 0 and get the score of
such a text; without labels of both classes the score is the share of toxic labels (0
if there are none) for every text; repeated rows and null ids keep their rows; only
the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import text_blocks
from bridgerec.llm.chunk_table import ChunkTable
from bridgerec.llm.labels import held_out, labelled_ids, labelled_sample
from bridgerec.llm.staging import Stage, shuffle_partitions

#: Letters of a subsequence, weight of a spanned letter, and the power of the normalised
#: kernel that is a word's value (a power of a kernel is one, and far likeness counts less).
ORDER, DECAY, POWER = 3, 0.7, 2
#: Letters of a landmark.
SHORTEST, LONGEST = 4, 8
#: Labelled texts of each class in which starts of words are counted, and on which the
#: machine is fitted, at most.
COUNTED, PER_CLASS = 32_000, 4000
#: Landmarks begin words in at least so many toxic texts, whatever their share.
LEAST_TEXTS = 3
#: Landmarks of one beginning that are taken as one.
FAMILY = 3
#: Rounds, and the weights, against that of all toxic texts, of the landmarks themselves and of
#: landmarks with an inserted letter; the weight of clean texts where scores are fitted.
ROUNDS, EXACT, SPOILED, CAUTION = 6, 1.0, 0.5, 50.0
#: A word's beginning counts for its text from this value; words that are added to a text's number
#: before the mean, so that one word of a short text is no proof; clean weight of the machine of texts.
ALIKE, PRIOR_WORDS, TEXT_CAUTION = 0.5, 40, 4.0
#: Hashes by which near copies in the sample are told.
HASHES = 12
#: Words whose values are computed at once, and stretches of them.
SLICE, STRETCHES = 20_000, 4096
#: Longer words are cut into stretches of this size that overlap by half.
WIDE = 32


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each row of ``s`` with the same row of ``t``
    (code points; 0 pads and matches nothing)."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    left, right = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T)
    weight = ((left[:, None] == right[None]) & (left[:, None] != 0)) * DECAY**2
    # inner[a, b]: weight of common subsequences of i letters in s[:a], t[:b], counted to the ends; only
    # the cells with room for these letters before and for the others behind are computed
    inner = None
    for i in range(1, ORDER):
        nxt = np.empty((ls + 1, lt + 1, n))
        for a in range(i, ls - ORDER + i + 1):
            run = np.zeros(n)
            for b in range(i, lt - ORDER + i + 1):
                run *= DECAY
                run += weight[a - 1, b - 1] if inner is None else inner[a - 1, b - 1] * weight[a - 1, b - 1]
                if a == i:
                    nxt[a, b] = run
                else:
                    np.multiply(nxt[a - 1, b], DECAY, out=nxt[a, b])
                    nxt[a, b] += run
        inner = nxt
    total = np.zeros(n)
    for a in range(ORDER, ls + 1):
        for b in range(ORDER, lt + 1):
            total += inner[a - 1, b - 1] * weight[a - 1, b - 1]
    return total


def _in_parts(s: np.ndarray, t: np.ndarray, rows: np.ndarray | None = None, others: np.ndarray | None = None) -> np.ndarray:
    """The kernel of rows of ``s`` with rows of ``t``, ``STRETCHES`` at a time."""
    rows = np.arange(len(s)) if rows is None else rows
    others = rows if others is None else others
    parts = [kernel(s[rows[a : a + STRETCHES]], t[others[a : a + STRETCHES]]) for a in range(0, len(rows), STRETCHES)]
    return np.concatenate([np.empty(0), *parts])


def _points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _pairs(points: np.ndarray) -> np.ndarray:
    """64 cells of the pairs of letters at most two places apart, as one bit mask a row."""
    out = np.zeros(len(points), np.uint64)
    for gap in (1, 2):
        a, b = points[:, :-gap].astype(np.uint64), points[:, gap:].astype(np.uint64)
        cell = ((a * np.uint64(31) + b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
        bit = np.where((a != 0) & (b != 0), np.uint64(1) << cell, np.uint64(0))
        out |= np.bitwise_or.reduce(bit, axis=1) if bit.shape[1] else np.uint64(0)
    return out


class Landmarks:
    """Values of words for the landmarks."""

    def __init__(self, strings: tuple[str, ...]):
        self.strings = strings
        self.points = [_points([x], len(x)) for x in strings]
        self.own = [float(kernel(p, p)[0]) for p in self.points]
        self.masks = [_pairs(p)[0] for p in self.points]

    def matrix(self) -> np.ndarray:
        """The normalised kernel between the landmarks."""
        pts = _points(list(self.strings), LONGEST)
        i, j = np.triu_indices(len(pts))
        k = np.zeros((len(pts), len(pts)))
        k[i, j] = _in_parts(pts, pts, i, j)
        k = np.maximum(k, k.T)
        d = np.sqrt(np.diag(k))
        return (k / d[:, None] / d[None, :]) ** POWER

    def values(self, words: list[str]) -> np.ndarray:
        """The value of each word for its nearest landmark, 0 for the others."""
        where, value, _, _ = self.nearest(words)
        found = np.zeros((len(words), len(self.strings)))
        rows = np.flatnonzero(where >= 0)
        found[rows, where[rows]] = value[rows]
        return found

    def nearest(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Each word's nearest landmark (-1 for none) and its value, and the same for the word's beginning."""
        if len(words) > SLICE:
            parts = [self.nearest(words[i : i + SLICE]) for i in range(0, len(words), SLICE)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        out = tuple(np.full(len(words), x) for x in (-1, 0.0, -1, 0.0))
        pieces, row, begins = [], [], []
        for k, w in enumerate(words):
            step = range(0, len(w), WIDE // 2) if len(w) > WIDE else (0,)
            pieces += [w[i : i + WIDE] for i in step]
            row += [k] * len(step)
            begins += [True] + [False] * (len(step) - 1)
        if not pieces or not self.strings:
            return out
        points, row, begins = _points(pieces, WIDE), np.array(row), np.array(begins)
        sizes = (points != 0).sum(axis=1)
        masks = _pairs(points)
        near = np.zeros((len(self.strings), len(pieces)), bool)
        for j, mask in enumerate(self.masks):
            near[j] = (np.bitwise_count(masks & mask) >= (int(mask).bit_count() + 1) // 2) & (sizes >= ORDER)
        lengths = np.array([len(x) for x in self.strings])
        for width in sorted({*lengths.tolist(), *(lengths + 1).tolist()}):
            of = np.flatnonzero((lengths == width) | (lengths + 1 == width))
            some = np.flatnonzero(near[of].any(axis=0))
            starts = np.maximum(sizes[some] - width, 0) + 1
            which = np.repeat(some, starts)
            at = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
            padded = np.concatenate([points, np.zeros((len(points), width), np.uint32)], axis=1)
            cut = padded[which[:, None], at[:, None] + np.arange(width)]
            itself = _in_parts(cut, cut)  # a stretch meets itself once, whatever the number of landmarks
            for length in (width - 1, width):
                js = np.flatnonzero(lengths == length)
                if not len(js):
                    continue
                k, met = np.nonzero(near[js][:, which] & (itself > 0))
                targets = np.concatenate([self.points[j] for j in js.tolist()])
                value = (_in_parts(cut, targets, met, k) / np.sqrt(np.array(self.own)[js][k] * itself[met])) ** POWER
                for j, a, b in zip(js.tolist(), *np.searchsorted(k, [np.arange(len(js)), np.arange(1, len(js) + 1)]), strict=True):
                    words, first = row[which[met[a:b]]], begins[which[met[a:b]]] & (at[met[a:b]] == 0)
                    self._raise(out[0], out[1], words, value[a:b], j)
                    self._raise(out[2], out[3], words[first], value[a:b][first], j)
        return out

    @staticmethod
    def _raise(nearest: np.ndarray, most: np.ndarray, words: np.ndarray, value: np.ndarray, j: int) -> None:
        """Take landmark ``j`` where its value is higher; ``words`` ascend."""
        if not len(words):
            return
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        own, best = words[starts], np.maximum.reduceat(value, starts)
        better = best > most[own]
        nearest[own[better]], most[own[better]] = j, best[better]


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased chunks between white space; runs of three or more single
    letters also as one."""
    chunks = text.lower().split()
    sizes = list(map(len, chunks))
    if sizes.count(1) >= 3:
        run: list[bytes] = []
        for c in [*chunks, b""]:
            if len(c) == 1 and c.isalnum():
                run.append(c)
            else:
                if len(run) >= 3:
                    chunks.append(b"".join(run))
                run = []
    return chunks


def plain(chunk: bytes) -> str:
    word = chunk.decode().lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


@lru_cache(maxsize=2)
def landmarks_of(strings: tuple[str, ...]) -> Landmarks:
    return Landmarks(strings)


@dataclass(frozen=True)
class ToxicityModel:
    """Linear machines over the landmarks and the logistic functions of their margins: of words
    (the largest margin counts) and of texts."""

    strings: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float
    text_weights: tuple[float, ...] = ()
    text_bias: float = 0.0
    text_slope: float = 0.0
    text_shift: float = -500.0

    def chunks(self, words: list[str]) -> list[tuple]:
        """(margin, landmark, value) of each word; the latter of its beginning, None if it is unlike all."""
        where, value, first, begin = landmarks_of(self.strings).nearest(words)
        margin = np.where(where >= 0, value * np.array(self.weights)[where], 0) + self.bias
        first = np.where(begin >= ALIKE, first, -1)
        return [(m, None if j < 0 else j, v) for m, j, v in zip(margin.tolist(), first.tolist(), begin.tolist(), strict=True)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        worst, mean = np.full(len(texts), self.bias), np.full(len(texts), self.text_bias)
        if self.strings:
            for k, found in enumerate(_table(self).values([words_of(t) for t in texts])):
                if found:
                    worst[k] = max(f[0] for f in found)
                    alike = sum(self.text_weights[j] * v for _, j, v in found if j is not None)
                    mean[k] += alike / (len(found) + PRIOR_WORDS)
        return np.maximum(_probability(self.slope * worst + self.shift), _probability(self.text_slope * mean + self.text_shift))


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@lru_cache(maxsize=2)
def _table(model: ToxicityModel) -> ChunkTable:
    return ChunkTable(lambda chunks: model.chunks([plain(c) for c in chunks]))


def _unlike(sample: DataFrame) -> DataFrame:
    """The sample without near copies (but for chance), which would make the words they share
    look telling: of texts of a label with the same smallest hash of three words in a row, by
    any of some hashes, one stays."""
    sample = sample.withColumn("key", F.xxhash64("text"))
    words = F.split(F.lower("text"), r"\s+")
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 3)))

    def smallest(k: int) -> Column:  # a second argument of the lambda would be the place in the array
        return F.array_min(F.transform("threes", lambda x: F.xxhash64(x, F.lit(k)))).alias(f"h{k}")

    hashed = sample.withColumn("words", words).withColumn("threes", threes).select("label", "key", *map(smallest, range(HASHES)))
    for k in range(HASHES):
        rest = [c for c in hashed.columns if c not in ("label", f"h{k}")]
        hashed = hashed.groupBy("label", f"h{k}").agg(F.min(F.struct(*rest)).alias("one")).select("label", "one.*")
    stay = F.broadcast(hashed.select("label", "key"))  # two of COUNTED rows at most
    return sample.join(stay, ["label", "key"], "left_semi").dropDuplicates(["label", "key"]).select("text", "label")


def _candidates(sample: DataFrame) -> DataFrame:
    """(start, toxic, clean): in how many texts of either class a word begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            label = batch.column(1).to_pylist()
            for a, block in text_blocks(batch.column(0)):
                for k, text in enumerate(block):
                    words = set(map(plain, set(words_of(text))))
                    longer = range(SHORTEST, LONGEST + 1)
                    counts[label[a + k]].update({w[:n] for w in words for n in longer if len(w) >= n})
        starts = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(starts, pa.string()), *(pa.array([counts[c][x] for x in starts], pa.int64()) for c in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["start", "toxic", "clean"])

    found = sample.mapInArrow(run, "start string, toxic long, clean long")
    return found.groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _telling(starts: DataFrame, pos: int, neg: int, tested: int) -> list[str]:
    """The starts that ``pos`` toxic texts have far oftener than ``neg`` clean ones, the surest first.

    If a start were as likely in either class, each of its n texts would be toxic with a
    chance of q; that ``toxic`` or more are has a chance of exp(-n KL(toxic / n, q)) at most
    (Chernoff), which must be under 0.1 / ``tested``."""
    toxic, clean, q = F.col("toxic"), F.col("clean"), pos / (pos + neg)
    n = toxic + clean
    excess = toxic * F.log(toxic / (n * q)) + F.when(clean > 0, clean * F.log(clean / (n * (1 - q)))).otherwise(0.0)
    found = starts.filter((toxic >= LEAST_TEXTS) & (toxic / pos > 4.0 * clean / neg))
    found = found.select("start", F.round(excess, 9).alias("excess")).filter(F.col("excess") > float(np.log(10 * max(tested, 1))))
    return [r[0] for r in found.orderBy(F.desc("excess"), F.desc(F.length("start")), "start").select("start").collect()]


def _choose(ranked: list[str]) -> tuple[str, ...]:
    """All strings but those that a better one begins or that begin with one; a telling start
    of ``FAMILY`` or more of them stands for these, as their number in a text is what tells."""
    chosen: dict[str, None] = {}
    begun: set[str] = set()  # what begins a chosen string
    for start in ranked:
        if start not in begun and not any(start[:n] in chosen for n in range(SHORTEST, len(start))):
            chosen[start] = None
            begun.update(start[:n] for n in range(SHORTEST, len(start) + 1))
    telling = set(ranked)
    family = Counter(x[:n] for x in chosen for n in range(SHORTEST, len(x)) if x[:n] in telling)
    for start, many in sorted(family.items(), key=lambda f: (-f[1], -len(f[0]), f[0])):
        under = [x for x in chosen if x.startswith(start)]
        if many >= FAMILY and len(under) >= FAMILY:
            for x in under:
                del chosen[x]
            chosen[start] = None
    return tuple(chosen)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on its active rows; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        new = np.linalg.solve(keep + xa.T @ x[on], xa.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with Platt's softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, w = np.stack([margin, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (target - p)) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from ``labels(doc_id, toxic)``; of a class at most ``COUNTED`` texts are
    searched for landmarks, and ``PER_CLASS`` fitted on."""
    spread = shuffle_partitions(docs.sparkSession)
    sample = stage.write(_unlike(labelled_sample(docs, labels, "toxic", COUNTED, id_col, text_col)), "sample")
    sizes = dict(sample.groupBy("label").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return ToxicityModel((), (), 0.0, 0.0, 500.0 if pos else -500.0)
    starts = _candidates(sample.repartition(spread)).filter(F.col("toxic") >= LEAST_TEXTS)
    starts = stage.write(starts, "starts")
    strings = _choose(_telling(starts, pos, neg, starts.count()))
    if not strings:
        every = dict(labelled_ids(labels, "toxic", id_col).groupBy("label").count().collect())  # the sample's share is another
        p = (every[1] + 1) / (every[1] + every[0] + 2)
        return ToxicityModel((), (), 0.0, 0.0, float(np.log(p / (1 - p))))
    keys = sample.select("label", F.xxhash64("text").alias("key"))
    few = [keys.filter(F.col("label") == c).orderBy("key").limit(PER_CLASS) for c in (0, 1)]
    keyed = sample.withColumn("key", F.xxhash64("text"))
    parts = keyed.join(F.broadcast(few[0].unionAll(few[1])), ["label", "key"], "left_semi").select("text", "label").repartition(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = landmarks_of(strings)
        for batch in batches:
            for a, block in text_blocks(batch.column(0)):
                words = [list(map(plain, words_of(text))) for text in block]
                every = sorted(set(chain.from_iterable(words)))
                at = {w: k for k, w in enumerate(every)}
                where, value, first, begin = marks.nearest(every)
                first = np.where(begin >= ALIKE, first, -1)
                rows = []
                for one in words:
                    own = np.array([at[w] for w in one], np.int64)
                    distinct = np.unique(own[where[own] >= 0])
                    alike = own[first[own] >= 0]
                    packed = [where[distinct].astype(np.int32), value[distinct], first[alike].astype(np.int32), begin[alike]]
                    rows.append([x.tobytes() for x in packed] + [len(one)])
                types = [*[pa.binary()] * 4, pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(1).slice(a, len(block))], names=["w", "v", "f", "b", "n", "label"])

    got = parts.mapInArrow(run, "w binary, v binary, f binary, b binary, n long, label int").collect()  # 2 * PER_CLASS rows at most
    got.sort(key=lambda r: (r[5], r[4], *map(bytes, r[:4])))
    label = np.array([r.label for r in got])
    bags = [(np.frombuffer(r.w, np.int32), np.frombuffer(r.v)) for r in got]
    means = np.zeros((len(got), len(strings)))
    for k, r in enumerate(got):
        np.add.at(means[k], np.frombuffer(r.f, np.int32), np.frombuffer(r.b) / (r.n + PRIOR_WORDS))
    return _fit(strings, bags, means, label)


def _fit(strings: tuple[str, ...], bags: list[tuple], means: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """The machines from the words' nearest landmarks and values and the mean values of each text."""
    marks = landmarks_of(strings)
    vals, vecs = np.linalg.eigh(marks.matrix())
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 0.05))) @ vecs.T
    words = _fit_words(marks, root, bags, label)
    # texts: means are small numbers, so they are scaled before the ridge
    x = means @ root * 100
    y = np.where(label == 1, 1.0, -1.0)
    weight = np.where(label == 1, 1 / (label == 1).sum(), TEXT_CAUTION / (label == 0).sum()) * len(y) / 2
    w = _machine(x, y, weight)
    slope, shift = _logistic(x @ w[:-1] + w[-1], y, weight)
    return ToxicityModel(strings, *words, tuple((root @ w[:-1] * 100).tolist()), float(w[-1]), slope, shift)


def _fit_words(marks: Landmarks, root: np.ndarray, bags: list[tuple], label: np.ndarray) -> tuple:
    """Weights, bias, slope and shift of the machine of words."""
    many = len(marks.strings)
    sizes = np.maximum(1, [len(w) for w, _ in bags])
    bag = np.repeat(np.arange(len(bags)), sizes)
    where = np.concatenate([w if len(w) else np.array([-1], np.int32) for w, _ in bags])
    value = np.concatenate([v if len(v) else np.zeros(1) for _, v in bags])
    # an insult is a landmark that few clean texts have; the others tell by their number alone
    common = np.zeros(many)
    for (w, v), y in zip(bags, label, strict=True):
        if y == 0:
            common[np.unique(w[v > 0.9])] += 1
    insult = np.flatnonzero(common <= max(1.0, 0.02 * (label == 0).sum()))

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), many))
        has = np.flatnonzero(where[rows] >= 0)
        x[has, where[rows[has]]] = value[rows[has]]
        return x

    exact = marks.values([marks.strings[j] for j in insult])
    spoiled = marks.values([x[:i] + "x" + x[i:] for x in (marks.strings[j] for j in insult) for i in range(1, len(x))])
    margin, chosen = value.copy(), np.zeros(len(where), bool)

    def worst(margin: np.ndarray) -> np.ndarray:
        """The row of each text's largest margin."""
        order = np.lexsort((-margin, bag))
        return order[np.append(True, bag[order][1:] != bag[order][:-1])]

    for _ in range(ROUNDS):
        top = worst(margin)
        toxic = top[label == 1]
        chosen[top[label == 0]] = True  # clean words stay once they were picked
        clean = np.flatnonzero(chosen)
        groups = [(dense(toxic), 1.0), (exact, EXACT), (spoiled, SPOILED), (dense(clean), -1.0)]
        x = np.concatenate([g for g, _ in groups])
        y = np.concatenate([np.full(len(g), np.sign(k)) for g, k in groups])
        weight = np.concatenate([np.full(len(g), abs(k) / max(1, len(g))) for g, k in groups])
        w = _machine(x @ root, y, weight * len(x) / 2)
        direct = root @ w[:-1]
        margin = np.where(where >= 0, value * direct[where], 0) + w[-1]
    # the score's middle leans to the toxic side: each clean text counts as CAUTION toxic ones
    weight = np.where(y > 0, weight / weight[y > 0].sum(), CAUTION * weight / weight[y < 0].sum())
    slope, shift = _logistic(x @ direct + w[-1], y, weight * len(x))
    return tuple(direct.tolist()), float(w[-1]), slope, shift


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; predicted is 1 from a score of 0.5."""
    key = docs.schema[id_col]
    schema = T.StructType([key, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.empty(0), *(model.scores(block) for _, block in text_blocks(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=schema.names)

    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, all columns as they were."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.empty(0), *(model.scores(block) for _, block in text_blocks(batch.column(at)))]
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(run, schema)
