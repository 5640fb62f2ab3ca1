"""Bottom-k sketches of word shingles as document fingerprints (operator 3), in DataFrame operations only.

A text's shingles are its runs of SHINGLE words (lower case, split at ASCII white space; a shorter text is one shingle).
Its sketch is the K smallest distinct 64-bit hashes, ascending; the fingerprint is their big-endian bytes in base64.
Sketches of parts merge into the sketch of the whole, and two of them estimate resemblance and containment; one
estimates how many distinct shingles there are. Below K shingles all of this is exact.

Defined results: a null text is the empty text; a text without words has an empty sketch and the fingerprint "";
two empty sketches are alike (1), an empty one and another aren't (0); rows that repeat are rows of their own, in the
order of doc_id (null first), then of a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import SPACE, searched, shuffle_partitions

SHINGLE, K = 5, 128
#: A bucket of one id is dealt by its texts if it holds so many times its share.
HOT = 2


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")


def shingle_hashes(word: Column, size: int = SHINGLE) -> Column:
    """A hash for each shingle of an array of words; the array should be a column, not an expression to repeat."""
    whole = F.when(F.size(word) > 0, F.array(F.xxhash64(word))).otherwise(F.array().cast("array<bigint>"))
    starts = F.slice(word, 1, F.greatest(F.size(word) - (size - 1), F.lit(1)))
    return F.when(F.size(word) < size, whole).otherwise(F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(word, i + j) for j in range(1, size)])))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the share of the hash range that the k smallest take."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has."""
    like = resemblance(a, b, k)
    shared = like * (distinct_count(a, k) + distinct_count(b, k)) / (1 + like)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def fingerprint(a: Column) -> Column:
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), "[\r\n]+", "")


def hashes_of(encoded: Column) -> Column:
    """The sketch that a fingerprint holds."""
    digits = F.hex(F.unbase64(encoded))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    half = lambda i, j: F.conv(F.substring(digits, i * 16 + 1 + 8 * j, F.lit(8)), 16, 10).cast("long")
    return F.transform(at, lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 1)))


def merged_by(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each key: each hash once, map-side; the k smallest of each of 64 salts, then of all, so a hot key is spread."""
    each = sketches.select(key, F.explode(column).alias("hash")).distinct().withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(64)))
    least = lambda keys: Window.partitionBy(*keys).orderBy("hash")
    some = each.withColumn("n", F.row_number().over(least([key, "salt"]))).where(F.col("n") <= k)
    return some.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("hash")), 1, k).alias(column))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, sketch and those of the next row in the order of doc_id; the last row's next is the first.

    Rows are dealt by ranges of doc_id into buckets, and a bucket of one id that holds far more than its share (null, say)
    by ranges of a hash of the text. A copy of the first row of each bucket (of the first bucket for the last) goes along
    to the bucket before, sorted behind its rows, so that one shuffle of the texts is enough. The driver holds one row
    for each bucket.
    """
    parts = shuffle_partitions(docs.sparkSession)
    buckets = 2 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    # An id on which several bounds fall holds more than a bucket's share: it gets a bucket of its own, the ids after it another.
    often = {v for v, n in Counter(at or []).items() if n > 1}
    bounds = sorted(set(at or []) | {v + 1 for v in often if v < (1 << 63) - 1})
    # Null ids come first, in a bucket of their own.
    keyed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(searched(bounds, F.col("doc_id"))))
    found = keyed.groupBy("bucket").agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).collect()
    share = max(1, sum(r[3] for r in found) // buckets)
    hot = {r[0]: -(-r[3] // share) for r in found if r[1] == r[2] and r[3] > HOT * share}
    first = {(r[0], 0): (r[1], None) for r in found if r[0] not in hot}
    tie, lookup = F.xxhash64("text"), lambda known, kind: F.create_map(*[F.lit(x) for k, v in sorted(known.items()) for x in (k, v)]) if known else F.create_map().cast(f"map<bigint,{kind}>")
    if hot:
        most = max(hot.values())
        slices = F.try_element_at(lookup(hot, "int"), F.col("bucket"))
        keyed = keyed.withColumn("slice", F.when(slices.isNotNull(), F.least(slices - 1, F.floor((tie.cast("double") + 2.0**63) / 2.0**64 * slices).cast("int"))).otherwise(0))
        least = keyed.where(F.col("bucket").isin(*hot)).groupBy("bucket", "slice").agg(F.min("doc_id"), F.min(tie)).collect()
        first |= {(r[0], r[1]): (r[2], r[3]) for r in least}
    else:
        most, keyed = 1, keyed.withColumn("slice", F.lit(0))
    number = {at: (at[0] + 1) * most + at[1] for at in first}
    keyed = keyed.withColumn("place", (F.col("bucket").cast("long") + 1) * most + F.col("slice"))
    order = sorted(number.values())
    # The place to which the first row of a place goes along.
    before = {p: order[i - 1] for i, p in enumerate(order)}
    ids = {number[at]: v[0] for at, v in first.items() if v[0] is not None}
    ties = {number[at]: v[1] for at, v in first.items() if v[1] is not None}
    own_tie = F.try_element_at(lookup(ties, "bigint"), F.col("place"))
    leads = F.col("doc_id").eqNullSafe(F.try_element_at(lookup(ids, "bigint"), F.col("place"))) & (own_tie.isNull() | (own_tie == tie))
    own = F.struct(F.lit(False).alias("ghost"), F.col("place").alias("place"))
    along = F.struct(F.lit(True).alias("ghost"), F.try_element_at(lookup(before, "bigint"), F.col("place")).cast("long").alias("place"))
    dealt = keyed.select("doc_id", "text", F.explode(F.when(leads, F.array(own, along)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.ghost", "to.place")
    dealt = dealt.repartition(buckets, "place")
    sketched = dealt.withColumn("words", words(F.col("text"))).withColumn("hashes", shingle_hashes(F.col("words"))).withColumn("sketch", sketch(F.col("hashes"))).drop("words", "hashes")
    by = Window.partitionBy("place").orderBy("ghost", F.col("doc_id").asc_nulls_first(), tie, "text")
    paired = sketched.withColumn("next_text", F.lead("text").over(by)).withColumn("next_sketch", F.lead("sketch").over(by))
    return paired.where(~F.col("ghost")).drop("ghost", "place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like the edited and the next text are."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).drop("next_text", "text")
    rows = rows.withColumn("edited_words", words(F.col("edited"))).withColumn("edited_hashes", shingle_hashes(F.col("edited_words"))).withColumn("edited_sketch", sketch(F.col("edited_hashes")))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(other).alias("edited_fingerprint"),
        resemblance(own, other).alias("near_edited"),
        resemblance(own, following).alias("near_next"),
        containment(own, other).alias("contained_in_edited"),
        distinct_count(own).alias("n_shingles"),
    )
