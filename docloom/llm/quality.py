"""Quality classifier: Naive Bayes support vectors.

A document's features are indicators of n-grams: of its words (1 and 2) and of its
words' shapes (1 to 3: first letter, capitals only, punctuation, same word again).
They are hashed, scaled by the log-count ratio of the two classes, and divided by
their length. A linear hinge-loss model is fitted to them by dual coordinate
descent, and its margins become probabilities by a logistic fit to the margins of
sampled rows that the model hasn't seen.

The fit uses a bounded sample of labelled rows (``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` of features at most, those with the
smallest hashed ids); only their feature numbers reach the driver. Scoring is a map
over whole texts with one broadcast of ``2 ** BITS`` weights, a fixed size.

Defined results: null text counts as empty, and an empty text has the model's score
for a text without features; with no labelled rows every score is 0.5, with one
class only it is the smoothed share of that class; labels that are null or belong to
no document are ignored, and of several for a document the lowest holds; of the
texts of one id the model learns one, that of the least features; words of any
length are hashed whole; ties are cut at the threshold, which itself counts as good;
repeated rows give repeated results; an empty table gives an empty result; other columns,
labels and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches
from docloom.llm.sampling import TRAIN_BYTES, bounded_sample, fold, within_bytes

BITS, TRAIN_ROWS, PASSES, COST, SMOOTHING = 18, 12_000, 12, 1.0, 1.0
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
BYTES_AT_ONCE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_CLASS = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 other ASCII, 5 beyond ASCII
_CLASS[128:] = 5
_CLASS[33:127] = 4
_CLASS[[*range(65, 91)]], _CLASS[[*range(97, 123)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SMALL = np.arange(256, dtype=np.uint64)
_SMALL[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all indicators of ``texts``, each once, ordered by row."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(np.cumsum(sizes), start, "right")

    # The words' hashes, all at once: value of the polynomial prefix at both ends, letters counted from the word's end.
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], end[:-1]]), np.diff(np.concatenate([[0], end[:-1], [len(data)]])))
    power = _powers(int((end - start).max()))
    offset = np.minimum(place - np.repeat(start - np.concatenate([[0], end[:-1]]), np.diff(np.concatenate([[0], end[:-1], [len(data)]]))), len(power) - 1)
    letter = np.where(space, np.uint64(0), (_SMALL[data] + np.uint64(1)) * power[np.maximum(offset, 0)])
    total = np.concatenate([[np.uint64(0)], np.cumsum(letter)])
    word = _mixed(total[end] - total[start])

    kind = _CLASS[data]
    count = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2, 4)]
    capitals, small, marks = (c[end] - c[start] for c in count)
    last = np.where(kind[end - 1] == 4, data[end - 1], 0)
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])])
    shape = (((kind[start] * 2 + ((capitals > 1) & (small == 0))) * 4 + np.minimum(marks, 3)) * 256 + last) * 2 + same
    shape = _mixed(shape.astype(np.uint64) + np.uint64(1))

    grams = []
    for salt, (base, most) in enumerate(((word, 2), (shape, 3))):
        gram = base
        for n in range(1, most + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(3) + base[n - 1 :]
            at = row[: len(gram)]
            whole = at == row[n - 1 :][: len(gram)]
            number = _mixed(gram + np.uint64(salt * 8 + n)) >> np.uint64(64 - BITS)
            grams.append((at[whole] << BITS) | number[whole].astype(np.int64))
    found = np.unique(np.concatenate(grams))
    return found >> BITS, found & ((1 << BITS) - 1)


def in_blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``BYTES_AT_ONCE`` together; a longer text is a block of its own."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "") + 1
        if size >= BYTES_AT_ONCE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _trained_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, label, found): the features of each row of ``docs(doc_id, text, label)`` as 32-bit integers; of one id the least."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for block in in_blocks(rows.column("text").to_pylist()):
                row, feature = features(block)
                out += [x.astype("<i4").tobytes() for x in np.split(feature, np.searchsorted(row, np.arange(1, len(block))))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "found"])

    rows = docs.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(extract, f"doc_id {kind}, label int, found binary")
    return rows.groupBy("doc_id", "label").agg(F.min("found").alias("found"))


def dual_coordinate_descent(found: list[np.ndarray], ratio: np.ndarray, scale: np.ndarray, chosen: np.ndarray, sign: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of the linear hinge-loss model on ``scale[i] * ratio[found[i]]``, i in ``chosen``; the last weight is the bias."""
    weight = np.zeros(len(ratio) + 1, np.float32)
    alpha = np.zeros(len(found))
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(chosen):
            row, value = found[i], ratio[found[i]] * scale[i]
            gradient = sign[i] * (float(weight[row] @ value) + float(weight[-1])) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # a row's length is 1, and the bias adds 1
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[row] += np.float32(step) * value
                weight[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weight


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through the margins, with smoothed targets."""
    positive = int(label.sum())
    target = np.where(label == 1, (positive + 1) / (positive + 2), 1 / (len(label) - positive + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35)))
        g = np.array([(p - target) @ margin, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[s @ margin**2, s @ margin], [s @ margin, s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


class Model:
    """score = logistic(slope * (sum of weights / sqrt(sum of squared ratios)) + shift)."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weight, self.square, self.bias, self.slope, self.shift = weight, square, bias, slope, shift

    @classmethod
    def constant(cls, score: float) -> Model:
        return cls(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, 1.0, float(np.log(score / (1 - score))))

    @classmethod
    def fit(cls, found: list[np.ndarray], label: np.ndarray) -> Model:
        if len(set(label.tolist())) < 2:
            return cls.constant((float(label.sum()) + 1) / (len(label) + 2))
        everything = np.arange(len(label))
        sign, share = np.where(label == 1, 1.0, -1.0), float(label.mean())
        cost = np.where(label == 1, COST / (2 * share), COST / (2 * (1 - share)))

        def fitted(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            counts = np.full((2, 1 << BITS), SMOOTHING)
            for i in chosen:
                counts[label[i], found[i]] += 1  # a row has each feature once
            ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
            scale = np.array([1 / max(float(np.sqrt(ratio[f] @ ratio[f])), 1e-9) for f in found], np.float32)
            return dual_coordinate_descent(found, ratio, scale, chosen, sign, cost), ratio, scale

        def margins(model: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
            weight, ratio, scale = model
            return np.array([float(weight[found[i]] @ ratio[found[i]]) * scale[i] + weight[-1] for i in rows])

        # The logistic fit uses rows that the model of the others hasn't seen.
        held = everything[everything % 5 == 0]
        others = everything[everything % 5 != 0]
        model = fitted(everything)
        unseen = len(held) > 20 and len(set(label[others].tolist())) == 2
        slope, shift = _logistic(margins(fitted(others), held), label[held]) if unseen else _logistic(margins(model, everything), label)
        weight, ratio, _ = model
        return cls(weight[:-1] * ratio, ratio**2, float(weight[-1]), max(slope, 1e-3), shift)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for block in in_blocks(texts):
            row, feature = features(block)
            total = np.bincount(row, self.weight[feature], len(block))
            length = np.sqrt(np.maximum(np.bincount(row, self.square[feature], len(block)), 1e-18))
            margin = total / length + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
        .where(fold("doc_id", FOLDS) != HELD_OUT)
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled rows of at most ``most_bytes`` of features together. The rows' ids are broadcast: ``rows`` bounds that."""
    small_batches(docs.sparkSession)
    chosen = bounded_sample(learning_labels(labels), rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    pairs = _trained_pairs(sample.select("doc_id", "text", "label"))
    got = within_bytes(pairs, F.octet_length("found"), ["doc_id", "label"], most_bytes).collect()
    if not got:
        return Model.constant(0.5)
    got.sort(key=lambda r: (bytes(r.found), r.label))
    order = np.random.default_rng(11).permutation(len(got))
    found, label = [np.frombuffer(got[i].found, "<i4") for i in order], np.array([int(got[i].label) for i in order])
    return Model.fit(found, label)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = shared.value.scores(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; the columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.where(scores("text") >= threshold)
