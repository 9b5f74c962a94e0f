"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of a text's lower-cased characters, weighted
by 1 + log(count) and by inverse document frequency, at unit length. The model is
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded
sample of labelled rows (``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` of features at most, those with the smallest hashed ids); a
temperature fitted on sampled rows that it hasn't seen calibrates its probabilities.
Document frequencies are counted over all rows that may be learnt from, in each
partition before the shuffle; the driver gets one number per feature.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is every text if there is nothing to learn from; a single language is always
predicted, with score 1; ties go to the first language in alphabetical order; of the
texts of one id and language the model learns one, that of the least features; texts
are used whole; repeated rows give repeated results; an empty table gives an empty
result; other columns, lang and ids are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches
from docloom.llm.sampling import TRAIN_BYTES, bounded_sample, fold, within_bytes

BITS, MOST, TRAIN_ROWS, PASSES = 15, 3, 8_000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the n-grams of one text, ascending."""
    letters = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    gram, found = np.zeros(len(letters), np.uint64), []
    for n in range(1, min(MOST, len(letters)) + 1):
        gram = (gram[: len(letters) - n + 1] ^ letters[n - 1 :]) * _STEP
        gram ^= gram >> np.uint64(29)
        found.append(((gram * _STEP) >> np.uint64(64 - BITS)).astype(np.uint16))
    if len(letters) < 1 << BITS - 3:  # sorting a short text's n-grams is cheaper than counting in an array of all features
        feature, count = np.unique(np.concatenate([*found, np.zeros(0, np.uint16)]), return_counts=True)
        return feature.astype(np.int64), count
    total = sum(np.bincount(x, minlength=1 << BITS) for x in found)
    feature = np.flatnonzero(total)
    return feature, total[feature]


class Model:
    """Languages, weights by language and feature, inverse document frequencies and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.z = np.zeros((len(languages), len(idf) + 1))
        self.n = np.zeros_like(self.z)

    def vector(self, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector, with the bias as a last feature."""
        value = (1 + np.log(count)) * self.idf[found]
        value = value / max(np.sqrt(value @ value), 1e-12)
        return np.append(found, len(self.idf)), np.append(value, 1.0)

    def _weight(self, at) -> np.ndarray:
        z = self.z[:, at]
        rate = (BETA + np.sqrt(self.n[:, at])) / ALPHA + L2
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / rate, 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        weight = self._weight(at)
        p = _softmax(weight @ value)
        p[label] -= 1
        gradient = p[:, None] * value
        square = self.n[:, at] + gradient**2
        self.z[:, at] += gradient - (np.sqrt(square) - np.sqrt(self.n[:, at])) / ALPHA * weight
        self.n[:, at] = square

    def finish(self) -> None:
        self.weight = self._weight(slice(None)).astype(np.float32)
        del self.z, self.n

    def logits(self, text: str) -> np.ndarray:
        at, value = self.vector(*counts(text))
        return self.weight[:, at] @ value

    def calibrate(self, logits: np.ndarray, label: np.ndarray) -> None:
        """The temperature of least log loss, by golden-section search over its logarithm."""
        rows = np.arange(len(label))

        def loss(t: float) -> float:
            x = logits / np.exp(t)
            x = x - x.max(1, keepdims=True)
            return float((np.log(np.exp(x).sum(1)) - x[rows, label]).mean())

        low, high, ratio = -4.0, 3.0, (np.sqrt(5) - 1) / 2
        while high - low > 1e-3:
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents) over all rows of ``texts(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for rows in batches:
            for text in rows.column("text").to_pylist():
                total[counts(text)[0]] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in texts.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r.feature] = r.n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled rows of at most ``most_bytes`` of features together; the ids of that sample are broadcast."""
    small_batches(docs.sparkSession)
    usable = learning_rows(docs)
    frequency, total = document_frequencies(usable)
    chosen = bounded_sample(usable.select("doc_id", F.col("lang").alias("label")), rows)
    sample = usable.join(F.broadcast(chosen.withColumnRenamed("label", "lang")), ["doc_id", "lang"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([f.astype("<u2").tobytes() for f, _ in pairs], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in pairs], pa.binary())],
                names=["doc_id", "lang", "found", "count"],
            )

    learnt = sample.select("doc_id", "lang", "text").mapInArrow(extract, f"doc_id {kind}, lang string, found binary, count binary")
    least = learnt.groupBy("doc_id", "lang").agg(F.min(F.struct("found", "count")).alias("x")).select("doc_id", "lang", "x.found", "x.count")
    got = within_bytes(least, F.octet_length("found") + F.octet_length("count"), ["doc_id", "lang"], most_bytes).select("lang", "found", "count").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.found), bytes(r["count"])))
    languages = sorted({r.lang for r in got})
    model = Model(languages, np.log((1 + total) / (1 + frequency)) + 1)
    vectors = [(*model.vector(np.frombuffer(r.found, "<u2").astype(np.int64), np.frombuffer(r["count"], "<i4")), languages.index(r.lang)) for r in got]
    order = np.random.default_rng(5)
    shuffled = order.permutation(len(vectors))
    held = shuffled[: len(vectors) // 5]
    for _ in range(PASSES):
        for i in order.permutation(shuffled[len(held) :]):
            model.learn(*vectors[i])
    model.finish()
    if len(held) and len(languages) > 1:
        model.calibrate(np.array([model.weight[:, vectors[i][0]] @ vectors[i][1] for i in held]), np.array([vectors[i][2] for i in held]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [shared.value.predict(t) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
