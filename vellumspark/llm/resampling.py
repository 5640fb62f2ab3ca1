"""Importance resampling of documents towards a target corpus, by hashed n-grams over overlapping chunks (operator 11).

Words are runs of ASCII letters and digits and of all that isn't ASCII, A-Z lowered. A feature is a run of 1 to `most`
consecutive words joined by one space, repeats counted; its bucket is the crc32 of its bytes modulo BUCKETS. A bucket's
gain is floor(1000 * ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), s of S features of the corpus and t of T of the
target. A document's weight is the floored mean of its features' gains; its score adds Gumbel noise from a hash of its
id, so that the highest scores are a draw without replacement in proportion to the weights' exponentials.

A text longer than CHUNK bytes is cut at word boundaries into chunks that carry the next most - 1 words; a chunk owns the
features that start in its own bytes. Chunks are dealt over all tasks, and their counts and sums of gains are added up by
document, so one long text is many small pieces of work. Shorter texts are read where they lie and never move. Counts by
bucket are summed in each task first; the driver and every task hold BUCKETS numbers, however large the corpus is.

Defined results: a null or empty text, or one without words, has no features and the weight 0; rows that repeat are rows
of their own (they share a score, and their ranks are consecutive); a null doc_id hashes as the empty text and comes last
among equal scores; an empty corpus gives an empty result; an empty target gives gains from its prior alone; other
columns are ignored, and `drawn` keeps them. docs should be a table (or a checkpoint), as a long text's chunks find each
other by its row's place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import chunked, shuffle_partitions, small_batches, texts_of, written
from vellumspark.llm.mixing import running

MOST, BUCKETS, CHUNK = 1, 10_000, 1 << 16
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(piece: bytes, owned: int, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words start in a piece's own bytes, and the bucket of each feature that starts there."""
    words = piece.split()
    own = len(words) if owned >= len(piece) else len(piece[:owned].split())
    crcs = list(map(zlib.crc32, words[:own]))
    found = [np.array(crcs, np.int64)]
    for n in range(1, most):
        # The crc of a longer run goes on from that of the shorter one.
        following = words[n : n + own]
        crcs = [zlib.crc32(word, zlib.crc32(b" ", crc)) for word, crc in zip(following, crcs, strict=False)]
        found.append(np.array(crcs, np.int64))
    return own, np.concatenate(found) % buckets


def pieces(docs: DataFrame, most: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, text, owned) of texts of at most `chunk` bytes as they lie, and of the others' chunks, dealt evenly."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text")
    short = rows.where(size <= chunk).withColumn("owned", size.cast("long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc_id, text = (batch.column(c)[k].as_py() for c in ("row", "doc_id", "text"))
                for piece, owned in chunked(text.translate(_WORDS), chunk, most - 1):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([piece], pa.binary()), pa.array([owned], pa.int64())], ["row", "doc_id", "text", "owned"])

    long = rows.where(size > chunk).mapInArrow(cut, "row long, doc_id long, text binary, owned long")
    # By a hash of the piece: the partition of a row is the same when a lost task runs again.
    return short, long.repartition(shuffle_partitions(docs.sparkSession), "row", F.xxhash64("text"))


def bucket_counts(docs: DataFrame, most: int = MOST, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """bucket, n: the features of all texts; a task sends each bucket once at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (b for whole in batches for b in small_batches(iter([whole]), "text")):
            found = [features(t.translate(_WORDS), n, most, buckets)[1] for t, n in zip(texts_of(batch.column("text")), batch.column("owned").to_pylist(), strict=True)]
            total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    short, long = pieces(docs, most, chunk)
    each = short.select("text", "owned").mapInArrow(count, "bucket int, n long").union(long.select("text", "owned").mapInArrow(count, "bucket int, n long"))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, chunk: int = CHUNK) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm. target has the column text."""
    found = []
    for texts in (docs, target.select(F.lit(None).cast("long").alias("doc_id"), "text")):
        own = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(texts, most, buckets, chunk).collect():  # one row a bucket
            own[bucket] = n
        found.append(own)
    s, t = found
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t[b] + 1) * whole_s) / (float(s[b] + 1) * whole_t))) for b in range(buckets)], np.int64)


def floored_mean(total: Column, n: Column) -> Column:
    """Floor of total / n in whole numbers, 0 where n is 0."""
    safe = F.greatest(n, F.lit(1).cast("long"))
    return ((total - F.pmod(total, safe)) / safe).cast("long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel value) from the first 32 bits of a hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(unit))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of each row of docs."""
    buckets = len(gain)
    schema = "row long, doc_id long, n_words long, n_features long, gain long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in small_batches(iter([whole]), "text")):
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, (text, owned) in enumerate(zip(texts_of(batch.column("text")), batch.column("owned").to_pylist(), strict=True)):
                own, at = features(text.translate(_WORDS), owned, most, buckets)
                out[:, k] = own, len(at), gain[at].sum()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, out)], ["row", "doc_id", "n_words", "n_features", "gain"])

    short, long = (rows.mapInArrow(weigh, schema) for rows in pieces(docs, most, chunk))
    names = ("n_words", "n_features", "gain")
    whole = long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names])
    return short.unionByName(whole).select("row", "doc_id", "n_words", "n_features", floored_mean(F.col("gain"), F.col("n_features")).alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most: int = MOST, buckets: int = BUCKETS, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score, rank of each row of docs; rank is null for what isn't drawn.

    floor(percent * N / 100) of the N documents with least_words words or more are drawn. Ranks are counted in ranges of
    the score, then within a range: no task sorts all rows.
    """
    known = weights(docs, gains(docs, target, most, buckets, chunk), most, chunk)
    scored = written(known.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = running(scored.where(fit).withColumn("one", F.lit(1).cast("long")), order, {"before": "one"}, "ranks")
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1).cast("long")).drop("one", "before")
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The rows of docs that are drawn, with their columns; docs is read again to fetch them."""
    ranks = resampled(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("row").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(ranks, "__row", "left_semi").drop("__row")
