"""Hard negatives of anchors by a vector-approximation file (operator 12).

Components become whole numbers, floor(SCALE * x); a score is an integer inner product. Anchors are a stated query set.
An anchor's positives are its first POSITIVES other rows of the same label; its negatives for a positive are the first
NEGATIVES rows of other labels whose score lies between `low` and `high` hundredths of the positive's.

The index is the approximation file: each dimension has CELLS cells between marks, quantiles of a bounded sample of rows
(at most about SAMPLE; every row is indexed, and marks change the work, never the result), and each row is its cells, one
byte a dimension, beside its exact numbers. Rows are dealt into blocks of at most BLOCK, anchors into blocks of at most
ANCHORS, and each pair of blocks is one small task, as in a product of matrices: nothing goes through the driver, and a
task's memory is that of two blocks. For an anchor, a table of the least and most that each cell of each dimension can
add gives bounds on the score of every row by lookup; only rows that can still be among the first are scored exactly:
for positives, rows whose upper bound reaches the POSITIVES-th best lower bound; for negatives, rows whose bounds meet
the window and whose upper bound reaches the NEGATIVES-th best lower bound of rows that are surely inside it. What each
pair of blocks returns, at most POSITIVES or POSITIVES * NEGATIVES rows an anchor, is merged by rank.

Defined results: rows with a null id, label or vector, or with any null or non-finite component, take no part; components
beyond +-2**20 count as that (scores stay within 64 bits); a shorter vector is filled with zeros; rows that repeat are
rows of their own, so an anchor's repeat can be its positive; equal scores come by smaller id; an anchor without other
rows of its label, or a positive without rows in its window, has no result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import shuffle_partitions, written

SCALE, CELLS, SAMPLE, LARGEST = 256, 64, 50_000, float(1 << 20)
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
BLOCK, ANCHORS = 65_536, 2_048
#: Rows whose bounds are looked up at once.
STRIPE = 4_096
_INDEX = "row long, vec_id long, label int, values binary, cells binary"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part, filled to one length."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    number = lambda x: F.floor(SCALE * F.greatest(F.least(x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))).cast("int")
    filled = F.concat(F.transform("embedding", number), F.array_repeat(F.lit(0), F.lit(size) - F.size("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), filled.alias("v"))


def marks_of(rows: DataFrame, cells: int, sample: int) -> np.ndarray:
    """For each dimension cells - 1 ascending bounds: quantiles over rows chosen by a hash of their id."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    at = [k / cells for k in range(1, cells)]
    found = some.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", at, 1000).alias("marks")).orderBy("d").collect()
    return np.array([r["marks"] for r in found], np.int64).reshape(len(found), cells - 1)


def indexed(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """The index (row, vec_id, label, values, cells) as a table in the shared folder, and the marks of its cells."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    marks = marks_of(rows, cells, sample)

    def quantise(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.int32).reshape(batch.num_rows, -1)
            cell = np.empty(v.shape, np.uint8)
            for d in range(v.shape[1]):
                cell[:, d] = np.searchsorted(marks[d], v[:, d], side="right") if d < len(marks) else 0
            binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), binary(v), binary(cell)], ["row", "vec_id", "label", "values", "cells"])

    return written(rows.select("row", "vec_id", "label", "v").mapInArrow(quantise, _INDEX), "va-file"), marks


class Block:
    """Rows of the index as matrices, and the bounds of their cells."""

    def __init__(self, table: pa.Table, marks: np.ndarray):
        n = table.num_rows
        matrix = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(n, -1)
        self.row, self.vec_id, self.label = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.values = matrix("values", np.int32).astype(np.int64)
        cells = matrix("cells", np.uint8)
        size = self.values.shape[1]
        # The outer cells end where this block's numbers do.
        least, most = self.values.min(axis=0)[:, None], self.values.max(axis=0)[:, None]
        known = marks if len(marks) == size else np.zeros((size, 0), np.int64)
        self.low = np.concatenate([np.minimum(least, known[:, :1]) if known.size else least, known], axis=1)
        self.high = np.concatenate([known - 1, np.maximum(most, known[:, -1:]) if known.size else most], axis=1)
        self.width = self.low.shape[1]
        self.cells = np.ascontiguousarray(cells.T.astype(np.int32) + self.width * np.arange(size, dtype=np.int32)[:, None]) if known.size or not size else np.zeros((size, n), np.int32) + np.arange(size, dtype=np.int32)[:, None]

    def bounds(self, anchor: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and most that the score of each row of a stripe can be."""
        one, other = anchor[:, None] * self.low, anchor[:, None] * self.high
        cells = self.cells[:, at]
        return np.minimum(one, other).ravel().take(cells).sum(axis=0), np.maximum(one, other).ravel().take(cells).sum(axis=0)


def nth_largest(values: np.ndarray, n: int, default: int) -> int:
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else default


_LEAST = -(1 << 62)


def nearest(block: Block, row: int, anchor: np.ndarray, label: int, most: int) -> list[tuple[int, int, int]]:
    """(row, vec_id, score) of the first `most` other rows of the label in the block."""
    best: list[tuple[int, int, int]] = []
    mine = np.flatnonzero((block.label == label) & (block.row != row))
    for start in range(0, len(mine), STRIPE):
        at = mine[start : start + STRIPE]
        lower, upper = block.bounds(anchor, at)
        reach = max(nth_largest(lower, most, _LEAST), best[-1][2] if len(best) == most else _LEAST)
        possible = at[upper >= reach]
        score = block.values[possible] @ anchor
        best += zip(block.row[possible].tolist(), block.vec_id[possible].tolist(), score.tolist(), strict=True)
        best = sorted(best, key=lambda x: (-x[2], x[1], x[0]))[:most]
    return best


def windowed(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """For each window (low, high) of scores the (row, vec_id, score) of the first `most` rows of other labels inside it."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    for start in range(0, len(block.row), STRIPE):
        stripe = slice(start, start + STRIPE)
        lower, upper = block.bounds(anchor, stripe)
        other = block.label[stripe] != label
        open_ = []
        for (low, high), known in zip(windows, best, strict=True):
            inside = other & (lower >= low) & (upper <= high)
            reach = max(low, nth_largest(lower[inside], most, _LEAST), known[-1][2] if len(known) == most else _LEAST)
            open_.append(other & (upper >= reach) & (lower <= high))
        possible = start + np.flatnonzero(np.logical_or.reduce(open_)) if open_ else np.zeros(0, np.int64)
        if not len(possible):
            continue
        score, ids, rows = block.values[possible] @ anchor, block.vec_id[possible], block.row[possible]
        for k, (low, high) in enumerate(windows):
            hit = np.flatnonzero((score >= low) & (score <= high))
            hit = hit[np.lexsort((rows[hit], ids[hit], -score[hit]))[:most]]
            best[k] = sorted([*best[k], *zip(rows[hit].tolist(), ids[hit].tolist(), score[hit].tolist(), strict=True)], key=lambda x: (-x[2], x[1], x[0]))[:most]
    return best


def first(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key with their rank; Spark keeps as many of each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cells: int = CELLS, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, embedding; anchors is a
    condition on vec_id and label. low and high are hundredths of the positive's score."""
    spark = vectors.sparkSession
    index, marks = indexed(whole_numbers(vectors), cells)
    n, chosen = index.count(), index.where(anchors).count()
    row_blocks, anchor_blocks = max(shuffle_partitions(spark), -(-n // block)), max(1, -(-chosen // anchor_block))
    spread = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    dealt = index.withColumn("block", spread("row", row_blocks)).withColumn("many", every(anchor_blocks))
    asked = index.where(anchors).drop("cells").withColumn("many", spread("row", anchor_blocks))

    def pairs(questions: DataFrame, answer, schema: str) -> DataFrame:
        sent = questions.withColumn("block", every(row_blocks))

        def run(rows: pa.Table, group: pa.Table) -> pa.Table:
            found = []
            if rows.num_rows and group.num_rows:
                whole = Block(rows, marks)
                for q in group.to_pylist():
                    found += answer(whole, q, np.frombuffer(q["values"], np.int32).astype(np.int64))
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names)

        return dealt.groupBy("block", "many").cogroup(sent.groupBy("block", "many")).applyInArrow(run, schema)

    def same(whole: Block, q: dict, anchor: np.ndarray) -> list[tuple]:
        return [(q["row"], *x) for x in nearest(whole, q["row"], anchor, q["label"], positives)]

    near = pairs(asked, same, "row long, positive_row long, positive_id long, positive_score long")
    near = first(near, ["row"], [F.col("positive_score").desc(), F.col("positive_id"), F.col("positive_row")], positives)
    # An anchor's positives, numbered: `positives` at most in a list.
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    ready = written(asked.join(listed, "row").select("row", F.col("vec_id").alias("anchor_id"), "label", "values", "many", "positives"), "anchors")

    def others(whole: Block, q: dict, anchor: np.ndarray) -> list[tuple]:
        # low * p <= 100 * score <= high * p in whole numbers.
        windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in q["positives"]]
        found = windowed(whole, anchor, q["label"], windows, negatives)
        return [(q["row"], p["rank"], *x) for p, rows in zip(q["positives"], found, strict=True) for x in rows]

    far = pairs(ready, others, "row long, nth long, negative_row long, negative_id long, negative_score long")
    far = first(far, ["row", "nth"], [F.col("negative_score").desc(), F.col("negative_id"), F.col("negative_row")], negatives)
    named = ready.select("row", "anchor_id", F.explode("positives").alias("p")).select("row", "anchor_id", F.col("p.rank").cast("long").alias("nth"), "p.positive_id", "p.positive_score")
    return named.join(far, ["row", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
