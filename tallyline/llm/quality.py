"""Quality scores by naive Bayes support vectors.

Indicators of n-grams (words, pairs of words, and runs of up to three token shapes) are hashed to a fixed number of
features, scaled by the log ratio of their shares in the two classes, and weighed by a linear model with hinge loss that
dual coordinate descent fits.  A logistic map learned on rows the model has not seen turns margins into probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_text, labelled_sample, map_batches

BITS = 18
MEMO = 400_000
# Every token is read in pieces of so many characters, the last one shorter: words of writing without blanks or encoded data
# would else each be a feature of its own that no other text has.
PIECE = 8
EPOCHS = 2000
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_A-ZÀ-ÖØ-Þ]+)|(\d+)|(\s+)")
_EDGE = ".,;:!?\"'()[]"


def shape(token: str) -> str:
    """A run of capitals, of other letters or of digits as one sign; marks as they stand, three equal ones at most."""
    plain = _KINDS.sub(lambda m: "A" if m[1] else "a" if m[2] else "9" if m[3] else " ", token)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", plain)


class Tokens(dict):
    """Maps a piece to the hashes of its word and of its shape, packed into one number; a bounded memo."""

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGE).lower()
        value = zlib.crc32(word.encode()) << 31 | zlib.crc32(shape(token).encode()) >> 1
        if len(self) >= MEMO:
            self.clear()
        self[token] = value
        return value


_TOKENS = Tokens()


def _bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Hash the parts of an n-gram to a feature."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for part in parts:
            h = (h ^ part) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def cut(text: str) -> list[str]:
    """The tokens of a text, each as its consecutive pieces of PIECE characters."""
    return [piece for t in text.split() for piece in ([t] if len(t) <= PIECE else [t[i:i + PIECE] for i in range(0, len(t), PIECE)])]


def indicators(text: str) -> np.ndarray:
    """The distinct features of a whole text, sorted; a text without tokens has none."""
    tokens = cut(text)
    if not tokens:
        return np.zeros(0, np.int32)
    packed = np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint64, len(tokens))
    word, form = packed >> np.uint64(31), packed & np.uint64(0x7FFFFFFF)
    again = np.zeros(len(tokens), np.uint64)  # whether a token repeats the one before it
    again[1:] = packed[1:] == packed[:-1]
    form_again = form ^ (again << np.uint64(40))
    found = [_bucket(1, word), _bucket(2, form_again), _bucket(3, word[:-1], word[1:]), _bucket(4, form_again[:-1], form_again[1:]),
             _bucket(5, form_again[:-2], form_again[1:-1], form_again[2:])]
    return np.unique(np.concatenate(found))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smoothing), np.full(1 << BITS, smoothing)]
    for row, label in zip(rows, labels):
        counts[int(label > 0)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = EPOCHS, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost * sum max(0, 1 - y (w x + b)), the bias being a feature of value one.

    Each step solves one dual variable exactly; it ends when the projected gradients of an epoch differ by less than
    `tolerance`, and raises an error if they still do not after `epochs`.
    """
    weights, bias = np.zeros(1 << BITS), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.arange(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        low, high = math.inf, -math.inf
        for i in order:
            row, value = rows[i], values[i]
            gradient = y[i] * (float(weights[row] @ value) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            low, high = min(low, projected), max(high, projected)
            if projected:
                before = alpha[i]
                alpha[i] = min(max(before - gradient / square[i], 0.0), cost)
                step = (alpha[i] - before) * y[i]
                weights[row] += step * value
                bias += step
        if high - low < tolerance or not len(order):
            return weights, bias
    raise ArithmeticError(f"the linear model did not converge in {epochs} epochs")


class QualityModel:
    """A weight for each feature (ratios folded in), a bias, and the logistic map of the margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=np.float64)) / math.sqrt(1 + len(row)) + self.bias

    def score(self, text: str) -> float:
        odds = self.slope * self.margin(indicators(text)) + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def logistic_map(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's map (slope, shift) with his smoothed targets, by Newton steps, each halved until the loss falls."""
    positive, negative = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    design, theta, ridge = np.stack([margins, np.ones(len(margins))]), np.zeros(2), 1e-3

    def loss(at: np.ndarray) -> float:
        odds = at @ design
        return float(np.logaddexp(0, odds).sum() - target @ odds + ridge / 2 * at @ at)

    now = loss(theta)
    for _ in range(1000):
        p = 1 / (1 + np.exp(-np.clip(theta @ design, -700, 700)))
        hessian = (design * (p * (1 - p))) @ design.T + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design @ (target - p) - ridge * theta)
        # Below this the loss differs by less than its own rounding.
        if np.abs(step).max() < 1e-7 * (1 + np.abs(theta).max()):
            return float(theta[0]), float(theta[1])
        while (then := loss(theta + step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        theta, now = theta + step, then
    raise ArithmeticError("the logistic map did not converge")


def train(rows: list[np.ndarray], labels: np.ndarray, min_rows: int = 3, folds: int = 5) -> QualityModel:
    """Fit on all rows; the logistic map is learned from margins of folds left out in turn.

    Features of fewer than `min_rows` rows carry no weight.  With one class alone the score is its smoothed share.
    """
    positive = int((labels > 0).sum())
    if positive in (0, len(labels)):
        return QualityModel(np.zeros(1 << BITS), 0.0, 0.0, math.log((positive + 1) / (len(labels) - positive + 1)))
    held = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= min_rows

    def fitted(use: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i][held[rows[i]]] for i in use]
        ratio = log_count_ratios(own, labels[use])
        scale = [1 / math.sqrt(1 + len(rows[i])) for i in use]
        weights, bias = dual_coordinate_descent(own, [ratio[r] * s for r, s in zip(own, scale)], labels[use])
        return weights * ratio, bias

    fold = np.arange(len(rows)) % folds
    margins = np.zeros(len(rows))
    for k in range(folds):
        use = np.flatnonzero(fold != k)
        if len(set(labels[use] > 0)) < 2:
            continue
        weights, bias = fitted(use)
        for i in np.flatnonzero(fold == k):
            margins[i] = weights[rows[i]].sum() / math.sqrt(1 + len(rows[i])) + bias
    slope, shift = logistic_map(margins, labels)
    weights, bias = fitted(np.arange(len(rows)))
    return QualityModel(weights, bias, max(slope, 0.0), shift)


def fit_labels(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column], label: str = "quality", fit_rows: int = 6_000,
               id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from at most `fit_rows` labelled documents of which `use(id)` holds, chosen by a hash of the id.

    The features of the sample, at most 2**18 for each row, reach the driver; no text does.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([indicators(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([found, *batch.columns[1:]], ["row", "label", "id"])

    sample = labelled_sample(docs, labels, label, use, fit_rows, id_col, text_col)
    kind = sample.schema["id"].dataType.simpleString()
    made = map_batches(sample.select("text", "label", "id"), work, f"row array<int>, label int, id {kind}").toArrow()
    order = np.argsort(np.array([zlib.crc32(str(i).encode()) for i in made.column("id").to_pylist()]), kind="stable")
    column = made.column("row").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    rows = [flat[ends[i]:ends[i + 1]] for i in order]
    return train(rows, np.array(made.column("label").to_pylist(), int)[order])


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the probability that the label is one.

    A NULL text counts as empty and has no features; rows repeating an id are scored each by its own text; an empty table
    gives no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, score double")
