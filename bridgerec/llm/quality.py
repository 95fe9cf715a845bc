"""Quality by a generalised additive model with pairwise interactions.

A text has some features of its form (``FEATURES``).  Each feature is cut into at
most ``BINS`` bins at quantiles of the training rows.  The model is a sum of one table
a feature and one table for each of the ``PAIRS`` pairs that interact most; the tables
are learned by boosting in turns: every round goes through all features (then pairs)
and adds to each one's table a shallow tree, that is a step function with few steps,
fitted to what the sum so far leaves unexplained (Lou et al., Accurate Intelligible
Models with Pairwise Interactions, 2013).  A score is the logistic function of table
entries added up, for a whole block of texts at once.

Defined cases: null and empty texts have all features 0 and get the score of such a
text; without labels of both classes the score is the share of label 1 (0 if there
are none) for every text; repeated rows and null ids keep their rows; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import row_blocks, text_bytes
from bridgerec.llm.labels import held_out, labelled_sample
from bridgerec.llm.staging import Stage
from bridgerec.llm.word_hash import SPACED, words_of

BINS, PAIR_BINS, PAIRS = 48, 10, 10
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
#: Most rows of one label that the model is fitted on.
PER_CLASS = 8000

#: Byte classes: other, lower, upper, digit, blank, line end, each mark of its own or in a group, UTF-8.
_CLASSES = ["other", "lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "bar", "symbol", "dash", "angle", "wide", "tail"]
FEATURES = [
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word",
    "line_words", "repeated_words", "upper_of_letters",
]


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    groups = {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|",
        "symbol": b"#$%&*@^~+=", "dash": b"-_/\\", "angle": b"<>{}[]()", "wide": bytes(range(0xC0, 256)), "tail": bytes(range(0x80, 0xC0)),
    }
    for name, members in groups.items():
        out[list(members)] = _CLASSES.index(name)
    return out


_TABLE = _class_table()


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the texts ``data[offsets[i]:offsets[i + 1]]``; ``offsets`` starts at 0."""
    n, c = len(offsets) - 1, len(_CLASSES)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(row * c + _TABLE[data], minlength=n * c).reshape(n, c)
    out = np.zeros((n, len(FEATURES)))
    size = np.maximum(sizes, 1)
    out[:, :c] = counts / size[:, None]
    hashes, starts, ends, words = words_of(data, offsets, SPACED)
    of = np.repeat(np.arange(n), words)
    length, some = ends - starts, np.maximum(words, 1)
    per = lambda flag: np.bincount(of[flag], minlength=n) / some
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(n)
    np.maximum.at(top, of[order][new], runs)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    letters = counts[:, _CLASSES.index("lower")] + counts[:, _CLASSES.index("upper")]
    rest = [
        np.log1p(sizes), np.log1p(words), np.bincount(of, weights=length, minlength=n) / some,
        per(length > 12), per(length < 3), distinct / some, top / some,
        words / (counts[:, _CLASSES.index("line")] + 1), per(again),
        counts[:, _CLASSES.index("upper")] / np.maximum(letters, 1),
    ]
    out[:, c:] = np.stack(rest, axis=1)
    return out


def column_features(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    blocks = [block_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets)]
    return np.concatenate([np.empty((0, len(FEATURES))), *blocks])


@dataclass
class AdditiveModel:
    """``cuts[f]`` divide feature f into bins; ``tables[f]`` has a value for each.
    ``pairs`` are (f, g, coarse cuts of f, of g, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f], side="right")]
        for f, g, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _steps(grad: np.ndarray, hess: np.ndarray, leaves: int = 4, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """The values of a tree of ``leaves`` steps over ordered bins, grown by the best split."""
    g, h = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    edges = [0, len(grad)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(edges) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gain = worth(a, k) + worth(k, b) - worth(a, b)
            gain[(h[k] - h[a] < least) | (h[b] - h[k] < least)] = 0
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), int(k[at])))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best division of a grid of bins into four quadrants: its worth and values."""
    g, h = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (grad, hess))
    best, values = 0.0, np.zeros_like(grad)
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            gs, hs = ((m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (g, h))
            gs, hs = np.array(gs), np.array(hs)
            worth = float((gs**2 / (hs + ridge)).sum())
            if worth > best:
                leaf = gs / (hs + ridge)
                best = worth
                values = np.empty_like(grad)
                values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = leaf
    return best, values


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boosted tables for labels 0 and 1; the same rows in any order give the same model."""
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    cuts = [_quantiles(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            if not len(cuts[f]):
                continue
            grad, hess = residual()
            size = len(tables[f])
            step = RATE * _steps(np.bincount(b, grad, size), np.bincount(b, hess, size))
            tables[f] += step
            total += step[b]

    coarse = [_quantiles(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cbins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def grid(f: int, g: int) -> tuple[np.ndarray, list[np.ndarray]]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = cbins[f] * shape[1] + cbins[g]
        return cell, [np.bincount(cell, r, shape[0] * shape[1]).reshape(shape) for r in residual()]

    every = [(f, g) for f in range(x.shape[1]) for g in range(f) if len(coarse[f]) and len(coarse[g])]
    ranked = sorted(((_quadrants(*grid(f, g)[1])[0], f, g) for f, g in every), reverse=True)[:PAIRS]
    grids = {(f, g): np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for _, f, g in ranked}
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in grids.items():
            cell, sums = grid(f, g)
            step = RATE * _quadrants(*sums)[1]
            table += step
            total += step.ravel()[cell]
    return AdditiveModel(base, cuts, tables, [(f, g, coarse[f], coarse[g], t) for (f, g), t in grids.items()])


def fit_quality(docs: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """A model from ``labels(doc_id, quality)``; at most ``PER_CLASS`` texts a label are
    used, and weighted back to the labels' own shares by the base value."""
    sample = labelled_sample(docs, labels, "quality", PER_CLASS, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [v.tobytes() for v in column_features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], names=["values", "label"])

    got = sample.mapInArrow(run, "values binary, label int").collect()  # 2 * PER_CLASS rows at most
    got.sort(key=lambda r: (r[1], bytes(r[0])))
    x = np.array([np.frombuffer(r[0]) for r in got]).reshape(-1, len(FEATURES))
    y = np.array([float(r[1]) for r in got])
    if not len(y) or y.min() == y.max():
        return AdditiveModel(500.0 if len(y) and y[0] else -500.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    model = fit_additive(x, y)
    usable = F.col("quality").cast("int")
    rows = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & usable.isin(0, 1))
    share = rows.agg(F.avg(usable)).first()[0]
    if share and 0 < share < 1:  # undo what the bound on each class did to the odds
        model.base += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


def quality_scores(
    docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; predicted is 1 from ``threshold``."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(column_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", predicted.alias("predicted"))
