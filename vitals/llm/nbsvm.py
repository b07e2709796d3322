"""Quality classifier: naive Bayes features with a support vector machine.

Indicators of n-grams are scaled by the log ratio of their class counts, and a linear model
with hinge loss is fitted to them by dual coordinate descent. N-grams are of words as they
stand (1 and 2 in a row) and of the shapes of words (1 to 3 in a row): letter case, digits,
marks, length, and whether a word repeats the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.textkernel import Words, chunks, distinct, mix, signed
from vitals.llm.tables import saved
from vitals.llm.toxicity import base_rate, calibrate, labelled_sample

#: Labelled rows per class to fit on at most.
EXAMPLES = 2000
#: Examples in which an n-gram stands at least; from fewer, its log-count ratio says nothing.
MIN_DOCS = 4

_byte = np.arange(256)
_CLASSES = [
    (_byte >= 97) & (_byte <= 122),
    (_byte >= 65) & (_byte <= 90),
    (_byte >= 48) & (_byte <= 57),
    _byte >= 128,
    np.isin(_byte, [ord(c) for c in ".,;:"]),
    np.isin(_byte, [ord(c) for c in "!?"]),
    np.isin(_byte, [ord(c) for c in "#*$%&|<>"]),
]


def shapes(w: Words) -> np.ndarray:
    """A number for the shape of each word."""
    size = w.end - w.start
    shape = np.minimum(size, 16) >> 2
    for k, inside in enumerate(_CLASSES):
        before = np.concatenate([[0], np.cumsum(inside[w.data])])
        n = before[w.end] - before[w.start]
        # upper case by none, one, more; the others by none, some
        shape = shape * 3 + (np.minimum(n, 2) if k == 1 else np.minimum(n, 1))
    again = np.zeros(len(size), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return shape * 2 + again


def chunk_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, n-gram) of a chunk, sorted, and the number of rows."""
    w = Words(texts, lower=False)
    doc, grams = [w.doc], [w.hash]
    h, at = w.ngrams(2)
    doc.append(w.doc[at])
    grams.append(h)
    if len(w.hash):
        words, w.hash = w.hash, mix(shapes(w).astype(np.uint64), 1000)
        for n in (1, 2, 3):
            h, at = w.ngrams(n, 2000)
            doc.append(w.doc[at])
            grams.append(h)
        w.hash = words
    d, g = distinct(np.concatenate(doc), np.concatenate(grams))
    return d, g, w.n_docs


def sample_features(rows: DataFrame) -> DataFrame:
    """(label, doc_id, n-grams) of labelled rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            d, g, n = chunk_features(chunk["text"])
            offsets = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["label"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(g)))], names=["doc_id", "label", "grams"])

    return rows.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, grams array<bigint>")


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float
    prior: float

    def margins(self, doc: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
        g = signed(grams)
        if not len(self.features) or not len(g):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.features, g), len(self.features) - 1)
        hit = self.features[at] == g
        return np.bincount(doc[hit], self.weights[at[hit]], minlength=n) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -60, 60)))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, n_features: int, passes: int = 40, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of the linear hinge-loss model with an upper bound `cost` on each dual variable.

    rows: features of each example; values: of each feature, the same in every row that has
    it. One coordinate at a time is set to its optimum, and the primal weights follow.
    """
    w = np.zeros(n_features + 1)
    values = np.append(values, 1.0)
    rows = [np.append(r, n_features) for r in rows]
    x = [values[r] for r in rows]
    norm = np.array([float(v @ v) for v in x])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], x[i]
            gradient = y[i] * float(w[r] @ v) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(step) * norm[i])
                w[r] += step * y[i] * v
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def fit_arrays(rows: list[np.ndarray], features: np.ndarray, good: np.ndarray, all_: np.ndarray, labels: np.ndarray, prior: float, c: float = 1.0) -> Model:
    """Fit on examples: rows of feature numbers, the features' hashes, and how many examples hold each (good ones, all).

    Without both classes every score is the prior.
    """
    none = Model(np.empty(0, np.int64), np.empty(0), 0.0, 1.0, float(np.log(prior / (1 - prior))), prior)
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return none
    ratio = np.log((good + 1) / (n1 + 2)) - np.log((all_ - good + 1) / (n0 + 2))
    y = np.where(labels == 1, 1, -1)
    cost = np.where(labels == 1, c * len(y) / (2 * n1), c * len(y) / (2 * n0))
    # every second row calibrates what the others teach, and the other way about
    half = np.arange(len(y)) % 2 == 0
    margins = np.zeros(len(y))
    scale = 1 / np.sqrt(max(1.0, float(np.mean([(ratio[r] ** 2).sum() for r in rows]))))
    values = ratio * scale
    for part in (half, ~half):
        k = np.flatnonzero(part)
        if len({*y[k].tolist()}) < 2:
            return none
        w = dual_coordinate_descent([rows[i] for i in k], values, y[k], cost[k], len(features))
        for i in np.flatnonzero(~part):
            margins[i] = values[rows[i]] @ w[rows[i]] + w[-1]
    weight = np.where(labels == 1, prior / n1, (1 - prior) / n0) * len(y)
    slope, intercept = calibrate(margins, y, weight)
    w = dual_coordinate_descent(rows, values, y, cost, len(features))
    return Model(features, values * w[:-1], float(w[-1]), slope, intercept, prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, per_class: int = EXAMPLES) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    N-grams of the sample are counted by class in Spark; only those of MIN_DOCS examples or
    more, and the examples as their numbers, come to the driver.
    """
    sample = saved(sample_features(labelled_sample(docs, labels, label, folds, held, per_class)).dropDuplicates(["doc_id"]))
    counts = sample.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("label").cast("long").alias("good"), F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("n") >= MIN_DOCS).toPandas().sort_values("gram")
    features = known["gram"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                g = np.sort(batch["grams"][k].values.to_numpy(zero_copy_only=False))
                at = np.flatnonzero(np.isin(shared.value, g, assume_unique=True)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(k, 1), batch["label"].slice(k, 1), pa.array([at], pa.list_(pa.int32()))], names=["doc_id", "label", "features"])

    rows = sample.select("doc_id", "label", "grams").mapInArrow(numbered, "doc_id long, label int, features array<int>").toPandas().sort_values("doc_id")
    return fit_arrays([np.asarray(r, np.int64) for r in rows["features"]], features, known["good"].to_numpy(float), known["n"].to_numpy(float), rows["label"].to_numpy(np.int64), base_rate(labels, label, folds, held))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, margin, score (0 to 1).

    A null or empty text has no n-gram and takes the score of the bias alone; a very long text
    is a chunk of its own; repeated rows and ties score alike; a null id stays null; other
    columns are left out; an empty table gives an empty table, and without labels of both
    classes every score is the base rate. A map without a shuffle; the model goes to each task
    once, and holds n-grams of EXAMPLES texts of each class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in chunks(batches, "text"):
            margins = m.margins(*chunk_features(chunk["text"]))
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(margins), pa.array(m.scores(margins))], names=["doc_id", "margin", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, margin double, score double")
