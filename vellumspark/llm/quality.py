"""Quality classification by co-training of two views (operator 1).

The text-content view sees hashed words and the buckets of shape measures (shares of upper case, digits, punctuation and
repeats, word and line lengths); the page-metadata view sees source, language and length with their pairs. Both are
FTRL-proximal logistic regressions. Over ROUNDS rounds each view is fitted, calibrated by Platt scaling on labelled rows
that it was not fitted on, and hands the unlabelled rows of which it is confident to the other view as pseudo-labels.
At last the calibrated log-odds of both views are combined by a logistic regression on those calibration rows, so a view
that tells little weighs little, and all documents are scored.

Bounds of the fit: LABELLED documents of each label and about UNLABELLED others, chosen by a hash of their id, one row
for each id (that with the least hash of its text; rows without an id are left out) and none of more than SAMPLE_BYTES
bytes; of these, by the hash, the first that fill FIT_SLOTS features; and MOST_NEW pseudo-labels of each kind and view in a round, the most confident ones. Everything else covers all
rows.

Defined results: null text is the empty text, null metadata a value of its own; whole texts are read; repeated rows each
get their row; without labels of both kinds every score is 0.5; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import arrow_map, batches_of, texts_of
from vellumspark.llm.sampling import FIT_ROWS, FIT_SLOTS, first_rows, hash_unit, labelled_sample, one_row_each
from vellumspark.llm.toxicity import BITS, SAMPLE_BYTES, Ftrl

LABELLED, UNLABELLED, ROUNDS, EPOCHS = 4_000, 6_000, 4, 2
CONFIDENT, MOST_NEW = 0.97, 500
KEEP = 0.5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFT = np.uint64(64 - BITS)


def _slots(names: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return np.unique((h >> _SHIFT).astype(np.uint32))


def content_features(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()
    known = set(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, int)
    n, w = max(1, len(text)), max(1, len(words))
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    lines = text.count(b"\n") + 1
    measures = {
        "upper": upper / max(1, upper + lower),
        "digits": digits / n,
        "marks": marks / n,
        "distinct": len(known) / w,
        "other": counts[128:].sum() / n,
    }
    shape = [f"{k} {round(float(v) * 20)}".encode() for k, v in measures.items()]
    shape += [b"top %d" % (20 * max((counts[c] for c in b"|*#$%&!"), default=0) // w)]
    shape += [b"words %d" % w.bit_length(), b"length %d" % min(20, n // w), b"lines %d" % (w // lines).bit_length()]
    return _slots([b"w " + x for x in known] + [b"s " + x for x in shape])


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "null" if n_chars is None else str(int(np.log2(max(1, n_chars)) * 2))
    names = [f"source {source}", f"lang {lang}", f"size {size}", f"source lang {source} {lang}", f"lang size {lang} {size}"]
    return _slots([x.encode() for x in names])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a small logistic regression, the intercept last, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class View:
    """One view's fit: sparse weights and a calibration."""

    def __init__(self, features: list[np.ndarray]):
        self.features = features
        self.scale = np.array([1.0, 0.0])

    def fit(self, rows: list[int], labels: list[int], held: list[int], truth: np.ndarray) -> None:
        model = Ftrl()
        for _ in range(EPOCHS):
            for i, label in zip(rows, labels, strict=True):
                model.learn(self.features[i], label)
        at = np.flatnonzero(model.z)
        weights = model.weights(at)
        at, weights = at[weights != 0], weights[weights != 0]
        self.intercept = float(weights[at == model.slots].sum())
        self.slots, self.weights = at[at != model.slots], weights[at != model.slots]
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[self.slots] = self.weights
        self.scale = logistic(np.array([[self.raw(self.features[i])] for i in held]), truth)

    def raw(self, slots: np.ndarray) -> float:
        return self.intercept + float(self.dense[slots].sum(dtype=np.float64))

    def odds(self, slots: np.ndarray) -> float:
        """Calibrated log-odds of good quality."""
        return float(self.scale[0] * self.raw(slots) + self.scale[1])


def co_train(content: list[np.ndarray], metadata: list[np.ndarray], labels: list[int | None]):
    """Two fitted views and the weights of their combination; labels are None where unknown."""
    known = [i for i, y in enumerate(labels) if y is not None]
    held = known[::4]
    fitted = [i for k, i in enumerate(known) if k % 4]
    truth = np.array([labels[i] for i in held])
    if len({labels[i] for i in fitted}) < 2 or len(set(truth.tolist())) < 2:
        return None
    views = [View(content), View(metadata)]
    given: list[dict[int, int]] = [{}, {}]
    unknown = [i for i, y in enumerate(labels) if y is None]
    for turn in range(ROUNDS + 1):
        for view, own in zip(views, given, strict=True):
            rows = sorted([*fitted, *own])
            view.fit(rows, [labels[i] if labels[i] is not None else own[i] for i in rows], held, truth)
        if turn == ROUNDS:
            break
        for k, view in enumerate(views):
            other = given[1 - k]
            p = [(float(sigmoid(view.odds(view.features[i]))), i) for i in unknown if i not in other]
            for label, best in ((1, sorted((-x, i) for x, i in p if x >= CONFIDENT)), (0, sorted((x, i) for x, i in p if x <= 1 - CONFIDENT))):
                other.update({i: label for _, i in best[:MOST_NEW]})
    both = np.array([[v.odds(v.features[i]) for v in views] for i in held])
    return views, logistic(both, truth)


def fit(docs: DataFrame, labels: DataFrame):
    """A model from labels (doc_id, quality), which hold training rows only: bounded rows in one task, sparse weights out."""
    sample, shares = labelled_sample(labels.select("doc_id", "quality"), "quality", LABELLED)
    total = docs.count()
    columns = docs.select("doc_id", "text", "source", "lang", "n_chars")
    chosen = one_row_each(columns.join(F.broadcast(sample), "doc_id"), SAMPLE_BYTES)
    # Other rows by a hash threshold, without those that are labelled; what is looked up is bounded by the threshold.
    some = one_row_each(columns.where(F.col("doc_id").isNotNull() & (hash_unit("doc_id", F.lit("unlabelled")) < UNLABELLED / max(1, total))), SAMPLE_BYTES)
    unlabelled = some.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("label", F.lit(None).cast("int")).withColumn("rank", hash_unit("doc_id"))
    rows = chosen.select("rank", "label", "text", "source", "lang", "n_chars").unionByName(unlabelled.select("rank", "label", "text", "source", "lang", "n_chars"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        content = [content_features(t).astype(np.int32) for t in texts_of(batch.column("text"))]
        meta = [metadata_features(*x).astype(np.int32) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
        return pa.record_batch([batch.column("rank"), batch.column("label"), pa.array(content, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], ["rank", "label", "content", "meta"])

    ready = arrow_map(rows, hashed, "rank double, label int, content array<int>, meta array<int>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = first_rows(batches, ("content", "meta"), FIT_SLOTS)
        got.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, len(r[2])))
        found = co_train([r[2] for r in got], [r[3] for r in got], [r[1] for r in got])
        if found is not None:
            views, mixed = found
            for k, view in enumerate(views):
                yield pa.record_batch([pa.array([k] * len(view.slots), pa.int32()), pa.array(view.slots, pa.int64()), pa.array(view.weights, pa.float64())], ["part", "slot", "weight"])
                yield pa.record_batch([pa.array([k + 2] * 3, pa.int32()), pa.array([0, 1, 2], pa.int64()), pa.array([view.intercept, *view.scale], pa.float64())], ["part", "slot", "weight"])
            yield pa.record_batch([pa.array([4] * 3, pa.int32()), pa.array([0, 1, 2], pa.int64()), pa.array(mixed, pa.float64())], ["part", "slot", "weight"])

    with batches_of(docs.sparkSession, FIT_ROWS):
        learned = ready.repartition(1).sortWithinPartitions("rank", "label").mapInArrow(train, "part int, slot long, weight double").collect()
    if not learned:
        return None
    parts = {k: sorted((r[1], r[2]) for r in learned if r[0] == k) for k in range(5)}
    # The sample keeps other shares of either label than the rows have.
    shift = float(np.log(shares.get(1, 1.0) / shares.get(0, 1.0)))
    return [([s for s, _ in parts[k]], [w for _, w in parts[k]], [w for _, w in parts[k + 2]]) for k in (0, 1)], [w for _, w in parts[4]], shift


class Scorer:
    def __init__(self, model):
        views, self.mixed, self.shift = model
        self.views = []
        for slots, weights, numbers in views:
            dense = np.zeros(1 << BITS, np.float32)
            dense[np.array(slots, np.int64)] = weights
            self.views.append((dense, numbers))

    def __call__(self, *features: np.ndarray) -> tuple[float, float, float]:
        """Scores of both views and of their combination."""
        odds = [n[1] * (n[0] + float(dense[f].sum(dtype=np.float64))) + n[2] for (dense, n), f in zip(self.views, features, strict=True)]
        both = self.mixed[0] * odds[0] + self.mixed[1] * odds[1] + self.mixed[2]
        return tuple(float(sigmoid(x - self.shift)) for x in (*odds, both))


def score(docs: DataFrame, model, keep: float = KEEP) -> DataFrame:
    """doc_id, score, predicted (1: good), text_score, meta_score of each row of docs."""
    shared, learned = docs.sparkSession.sparkContext.broadcast(model), model is not None
    held: dict[int, Scorer] = {}

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        if learned and 0 not in held:
            held[0] = Scorer(shared.value)
        meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)
        out = [held[0](content_features(t), metadata_features(*m)) if 0 in held else (0.5, 0.5, 0.5) for t, m in zip(texts_of(batch.column("text")), meta, strict=True)]
        text, page, both = (np.array(x) for x in zip(*out, strict=True))
        return pa.record_batch([batch.column("doc_id"), pa.array(both), pa.array((both >= keep).astype(np.int32)), pa.array(text), pa.array(page)], ["doc_id", "score", "predicted", "text_score", "meta_score"])

    return arrow_map(docs.select("doc_id", "text", "source", "lang", "n_chars"), scored, "doc_id long, score double, predicted int, text_score double, meta_score double")
