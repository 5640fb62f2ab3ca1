"""Bounded samples of labelled rows, the same on every run, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = float(1 << 63)
#: So many features, of four bytes each, are held by the task that fits a classifier; it takes FIT_ROWS rows at once.
FIT_SLOTS, FIT_ROWS = 1 << 26, 64


def hash_unit(*columns):
    """A number in [0, 1) from the hash of columns."""
    return (F.xxhash64(*columns).cast("double") + _RANGE) / (2 * _RANGE)


def labelled_sample(labels: DataFrame, label: str, bound: int) -> tuple[DataFrame, dict[int, float]]:
    """At most `bound` rows (doc_id, label, rank) for each label 0 and 1, and the share of its rows that each label keeps.

    labels has one integer label column; rows whose doc_id or label is null are left out, and a document labelled twice
    takes its larger label. Rows are chosen by a hash of their id; all rows are kept while they are within the bound.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    kept = None
    for value, n in sorted(counts.items()):
        rows = known.where(F.col("label") == value).withColumn("rank", hash_unit("doc_id"))
        if n > bound:
            # A little more than the bound by threshold, then the bound itself: what is sorted is bounded as well.
            rows = rows.where(F.col("rank") < 1.1 * bound / n + 100 / n).orderBy("rank", "doc_id").limit(bound)
        kept = rows if kept is None else kept.unionByName(rows)
    if kept is None:
        kept = known.withColumn("rank", hash_unit("doc_id"))
    # Another hash for the order of training: by the first one, a label of which few rows are kept would come in one lump.
    kept = kept.withColumn("rank", hash_unit("doc_id", F.lit("order")))
    return kept, {v: min(1.0, bound / n) for v, n in counts.items()}


def one_row_each(rows: DataFrame, most_bytes: int) -> DataFrame:
    """One row for each doc_id, that with the least hash of its text, of those that have at most so many bytes.

    Repeats of an id are dropped map-side, so that what is gathered is bounded by the number of ids, whatever repeats.
    """
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    others = [c for c in rows.columns if c != "doc_id"]
    return short.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("__hash"), *others)).alias("__row")).select("doc_id", *[F.col(f"__row.{c}").alias(c) for c in others])


def first_rows(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...], most: int) -> list[tuple]:
    """(rank, label and the named lists) of the rows that come first, as long as their lists hold at most so many values.

    The others are read and left, so that memory is bounded by values, not by rows.
    """
    got, room = [], most
    for batch in batches:
        if room < 0:
            continue
        columns = []
        for name in lists:
            flat, ends = batch.column(name).flatten().to_numpy(), batch.column(name).offsets.to_numpy()
            columns.append([flat[x - ends[0] : y - ends[0]].copy() for x, y in zip(ends, ends[1:])])
        for row in zip(batch.column("rank").to_pylist(), batch.column("label").to_pylist(), *columns, strict=True):
            room -= sum(map(len, row[2:]))
            if room < 0:
                break
            got.append(row)
    return got
