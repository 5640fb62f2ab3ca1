"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 6).

Features of a text, each once: its words, their stems (first STEMS bytes of longer words, for inflected forms), word
pairs and pairs with one or two words between, hashed into 2**BITS slots. Words are lower-cased at A-Z and split at
ASCII white space; punctuation at their ends goes. Training takes a bounded sample of labelled documents in a fixed
order, with per-coordinate rates and L1, so few weights stay; only those are broadcast.

Bounds of the fit: SAMPLE documents of each label, one row for each id (that with the least hash of its text), and none
of more than SAMPLE_BYTES bytes; of these, in the order of training (a hash of the id), the first that fill FIT_SLOTS
features. All documents are scored.

Defined results: a null or empty text has no feature and gets the score of the intercept; whole texts are read;
repeated rows each get their row; without training rows every score is 0, and with labels of one class only every score
is that class's (0 or 1), as nothing can be told apart; an empty table gives an empty result; other
columns are ignored, and filtering keeps the columns of the input as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import arrow_map, batches_of, small_batches, texts_of
from vellumspark.llm.sampling import FIT_ROWS, FIT_SLOTS, first_rows, labelled_sample, one_row_each

BITS, STEMS = 22, (4, 6)
#: At most so many documents of each label are learned from, of so many bytes each.
SAMPLE, SAMPLE_BYTES = 8_000, 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 4.0, 1.0, 4
THRESHOLD = 0.3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENDS = b".,;:!?\"'()[]{}*#$%&|-_"
_SHIFT = np.uint64(64 - BITS)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def features(text: bytes) -> np.ndarray:
    """The slots that a text fills, ascending."""
    words = [w.strip(_ENDS) for w in text.translate(_LOWER).split()]
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    stems = list({w[:n] for w in words for n in STEMS if len(w) > n})
    out = [h * _MIX[0]]
    if stems:
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, stems), np.uint64, len(stems)) * _MIX[1] + _MIX[2])
    for gap in (1, 2, 3):
        if n > gap:
            out.append((h[:-gap] * _MIX[2] ^ (h[gap:] + np.uint64(gap)) * _MIX[3]) * _MIX[1])
    return np.unique((np.concatenate(out) >> _SHIFT).astype(np.uint32))


class Ftrl:
    """Per-coordinate FTRL-proximal; the intercept is a coordinate of its own without L1."""

    def __init__(self, slots: int = 1 << BITS):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)
        self.slots = slots

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.slots, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, filled: np.ndarray, label: int) -> None:
        at = np.append(filled.astype(np.int64), self.slots)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept) learned from labels (doc_id, toxic), which hold training rows only."""
    sample, shares = labelled_sample(labels.select("doc_id", "toxic"), "toxic", bound)
    # 2 * bound rows at most, so broadcasting their ids is bounded, and documents are not shuffled.
    chosen = one_row_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), SAMPLE_BYTES)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = [features(t) for t in texts_of(batch.column("text"))]
        return pa.record_batch([batch.column("rank"), batch.column("label"), pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32()))], ["rank", "label", "slots"])

    rows = arrow_map(chosen.select("rank", "label", "text"), hashed, "rank double, label int, slots array<int>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(first_rows(batches, ("slots",), FIT_SLOTS), key=lambda r: (r[0], r[1], len(r[2])))
        if len({label for _, label, _ in got}) < 2:
            return
        model = Ftrl()
        for _ in range(EPOCHS):
            for _, label, slots in got:
                model.learn(slots, label)
        at = np.flatnonzero(np.abs(model.z[:-1]) > L1)
        at = np.append(at, model.slots)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(model.weights(at), pa.float64())], ["slot", "weight"])

    with batches_of(docs.sparkSession, FIT_ROWS):
        learned = rows.repartition(1).sortWithinPartitions("rank", "label").mapInArrow(fit, "slot long, weight double").collect()
    if not learned:
        return np.zeros(0, np.int64), np.zeros(0), 40.0 if set(shares) == {1} else -40.0
    pairs = {r[0]: r[1] for r in learned}
    # The sample keeps other shares of either label than the rows have; the intercept takes that back.
    intercept = pairs.pop(1 << BITS) + float(np.log(shares.get(0, 1.0) / shares.get(1, 1.0)))
    return np.array(list(pairs), np.int64), np.array(list(pairs.values())), intercept


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        slots, weights, self.intercept = model
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[slots] = weights

    def __call__(self, text: bytes) -> float:
        logit = self.intercept + float(self.dense[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def scores(docs: DataFrame, model, keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the boolean column `keep`, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[int, Scorer] = {}

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        if 0 not in held:
            held[0] = Scorer(shared.value)
        found = np.array([held[0](t) for t in texts_of(batch.column("text"))])
        return pa.record_batch([batch.column("doc_id"), batch.column(keep), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", keep, "score", "predicted"])

    return arrow_map(docs.select("doc_id", keep, "text"), score, f"doc_id long, {keep} boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array([scorer(t) < threshold for t in texts_of(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
