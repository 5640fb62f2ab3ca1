"""Helpers that the corpus operators share: shared storage, Arrow row functions, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: ASCII white space: 0x20 and 0x09 to 0x0D, which is also what bytes.split() takes.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_NEXT = re.compile(rb" *[^ ]+")
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only in local mode, where that is unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="vellumspark-")
    return _own_dir[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor loses nothing.

    The cluster's owner cleans the folder as it does for checkpoints; tables of one session share a name for that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.conf.get('spark.app.id', 'session')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with `block`, dealt evenly by their place in the table: rows that repeat, or share any key, make no block large.

    The place is that within the scan, which a task that is run again finds the same.
    """
    return rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def hash_words(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text whose A-Z are lowered first."""
    words = text.translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, b"" for null, without decoding them."""
    if not isinstance(column, pa.LargeBinaryArray):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of that column, or of one row, so that memory is bounded by it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float)))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand at most so many rows at once to Python: buffers on both sides of a worker stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def searched(bounds: list, value: Column) -> Column:
    """How many of the ascending bounds are at most value: a binary search that stays in the JVM."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) <= value), at + step).otherwise(at),
    )


def chunked(text: bytes, most: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text in which words stand between single or repeated b" ", each with how many of its bytes are its own.

    A piece owns about `most` bytes, cut at a word's end (a longer word stays whole), and carries the next `carry` words
    behind them: what starts in a piece's own bytes and takes up to carry + 1 words is found in that piece, and only there.
    """
    start = 0
    while start < len(text):
        end = text.find(b" ", start + most)
        end = far = len(text) if end < 0 else end
        for _ in range(carry):
            word = _NEXT.match(text, far)
            if word is None:
                break
            far = word.end()
        yield text[start:far], end - start
        start = end
