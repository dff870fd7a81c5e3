"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on the executors. The trees are fitted on the driver from at most
`TRAIN_ROWS` labelled rows (chosen by hash of the id), then flattened into arrays (feature, threshold, leaf values,
complete trees), which go to the executors (some kilobytes) for vectorised traversal.

Null and empty texts get the score of a text without words; texts of any length are measured whole; equal rows are scored
one by one, and rows whose id repeats are that many examples, of which the first TRAIN_ROWS by hash are used; ties between splits go to the first
feature and the lowest threshold; a table without usable labels scores 0.5 throughout; other columns are passed on, but one named
a column with the name of the score is refused by `score`, as the result has it, but not by `accepted`; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats as S

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAF = 64, 4, 60, 0.2, 1.0, 5.0
N_FEATURES = 16


def features(text: pa.Array) -> np.ndarray:
    m = {k: v.astype(np.float64) for k, v in S.measure(text).items()}
    words, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    mean = m["word_chars"] / words
    cols = [np.log1p(m["n_words"]), mean, m["sq_word"] / words - mean**2, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / chars, m["n_letters"] / chars]
    cols += [m["n_digits"] / chars, m["n_bangs"] / words, m["n_stops"] / words, m["n_distinct"] / words, m["entropy"], m["n_echoes"] / words, np.log1p(m["n_lines"]), m["n_words"] / lines]
    return np.stack(cols, 1)


class Trees:
    """Complete binary trees of one depth, in arrays."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    inner = 2**DEPTH - 1
    if not len(x):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin <= b iff value <= edges[b]
    rate = np.clip(y.mean(), 0.001, 0.999)
    base = float(np.log(rate / (1 - rate)))
    f = np.full(len(x), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * BINS + binned[:, j]
                gl = np.cumsum(np.bincount(cell, g, many * BINS).reshape(many, BINS), 1)
                hl = np.cumsum(np.bincount(cell, h, many * BINS).reshape(many, BINS), 1)
                nl = np.cumsum(np.bincount(cell, minlength=many * BINS).reshape(many, BINS), 1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain = np.where((nl >= LEAF) & (nt - nl >= LEAF), gain, 0)[:, : len(e)]
                at = gain.argmax(1)
                better = gain[np.arange(many), at] > best + 1e-9
                best = np.where(better, gain[np.arange(many), at], best)
                feature[first : first + many] = np.where(better, j, feature[first : first + many])
                threshold[first : first + many] = np.where(better, e[at], threshold[first : first + many])
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        f += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees]), np.stack([t[2] for t in trees]), base)


def sampled_labels(labels: DataFrame, target: str, fold: int, folds: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most `rows` labelled ids outside the held-out fold, by hash."""
    free = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (C.crc_mod(folds) != fold))
    return free.select("doc_id", F.col(target).cast("int").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    C.ready(docs.sparkSession)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled_labels(labels, "quality", 1, 3, rows)), "doc_id")  # at most `rows` rows

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(C.texts_of(batch))
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["__label"], pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    got = C.map_arrow(chosen.select("doc_id", "text", "__label"), compute, "id string, label int, x array<double>", C.SMALL_SLICE)
    got = got.orderBy(F.xxhash64("id"), "id", "label", "x").limit(rows).toArrow()  # more only if ids repeat
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    y = got["label"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order of arrival
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, name: str = "__score") -> DataFrame:
    """All columns of docs, and the score."""
    C.ready(docs.sparkSession)
    C.reserved(docs, name)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.select("*").schema.add(name, "double")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model.value.score(features(C.texts_of(batch)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    return C.map_arrow(docs, apply, schema, C.SMALL_SLICE)


def accepted(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows that the classifier does not reject, with all columns of docs, whatever their names."""
    taken, name = {*map(str.lower, docs.columns)}, "__score"
    while name in taken:
        name += "_"
    return score(docs, trees, name).where(F.col(name) >= 0.5).drop(name)
