"""Line dedup by a deletion-neighbourhood join (operator 7).

A line is compared as its words (lower case, split at white space). Two lines match if their word edit distance is within
the bound: one word inserted, removed or replaced, and at most RATE of the shorter line's words, so that lines of fewer
than 1 / RATE words match only if they are equal. A line is removed if an earlier line matches it; the earliest stays.
The order is that of doc_id (null last), then of a hash of the text (for rows that share an id), then of line numbers.
`shortest` can leave lines of fewer words alone, such as headings; by default each line that has a word takes part.

1. Lines are reduced to hashes; equal lines become one class with its earliest place, summed map-side, so a line that a
   third of the documents hold is one row.
2. Lines that can have a near partner are found without loss: within one edit, two lines share nearly their first or
   their last half. Only classes that share such an end with another class go on.
3. Those emit their deletion variants as hashed keys. Replacing: the line without word i, keyed with i and the length;
   equal keys mean distance 1 at most, so an earlier match exists exactly if the key's earliest place is earlier.
   Inserting: the line without word i equals a whole line; a key holds the earliest whole line and the earliest variant.
   Both are minima for each key: no pairs of a group are emitted, however large it is.
4. A match found by hash is verified on the words by edit distance, then takes effect.

Defined results: null and empty texts and lines are kept as they are; rows that repeat (same doc_id and text) are one
document and lose the same lines; rows that share an id, or have none, but differ in text are documents of their own; an
empty table gives an empty result; other columns pass through untouched. Of a text of more than 2**24 lines, those
beyond count as that line when places are compared, and stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vellumspark.llm.common import small_batches, texts_of, written

SHORTEST, RATE = 1, 0.1
#: Lines of so many words are within RATE of a line that is one edit away.
FUZZY = round(1 / RATE)
#: So many documents at most are named to every task; beyond that, documents are moved to meet their names.
SENT = 1_000_000
_DECIMAL = "decimal(38,0)"
_LINES = 1 << 24


def words_of(line: bytes) -> list[bytes]:
    return line.decode().lower().encode().split()


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def whole(words: list[bytes]) -> int:
    return signed(xxh3_64_intdigest(b" ".join(words)))


def ends_of(words: list[bytes]) -> list[int]:
    """Keys of the first and the last m words, m = 2 * (n // 4); where one word less has another m, of that m too.

    An edit leaves one of both whole, and lines of n and n + 1 words share an m.
    """
    n = len(words)
    sizes = {n // 4 * 2, (n - 1) // 4 * 2}
    return [signed(xxh3_64_intdigest(b"%d %d " % (side, m) + b" ".join(part))) for m in sorted(sizes) for side, part in ((0, words[:m]), (1, words[n - m :]))]


def variants(words: list[bytes]) -> list[tuple[int, int]]:
    """(key of a replacement at i, hash of the line without i) for each word i."""
    n, out = len(words), []
    for i in range(n):
        rest = b" ".join(words[:i] + words[i + 1 :])
        out.append((signed(xxh3_64_intdigest(b"%d %d " % (n, i) + rest)), signed(xxh3_64_intdigest(rest))))
    return out


def word_distance(a: list[bytes], b: list[bytes], most: int) -> int:
    """Edit distance over words, or most + 1 if it is above `most`: a band of the usual table."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            now[j] = min(row.get(j - 1, most + 1) + (x != b[j - 1]), row.get(j, most + 1) + 1, now.get(j - 1, most + 1) + 1)
        row = now
    return min(row.get(len(b), most + 1), most + 1)


def _number(n: int) -> Column:
    return F.lit(Decimal(n)).cast(_DECIMAL)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash, doc: a number for each document, ascending in their order.

    It holds the id and 38 bits of the text's hash; without an id, 62 bits of the hash stand in for it, above all ids.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    bits = lambda n: F.shiftrightunsigned("text_hash", 64 - n).cast(_DECIMAL)
    number = F.coalesce(F.col("doc_id").cast(_DECIMAL), _number(1 << 63) + bits(62))
    return rows.withColumn("doc", (number * _number(1 << 38) + bits(38)).cast(_DECIMAL))


def _place() -> Column:
    """(doc, line) as one number in the same order, of which minima are kept in hash aggregates."""
    return (F.col("doc") * _number(_LINES) + F.least("line", F.lit(_LINES - 1))).cast(_DECIMAL)


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, text_hash, doc, line, hash, ends of each line that takes part; docs as from identified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, numbers, hashes, keys = [], [], [], []
            for row, text in enumerate(texts_of(batch.column("text"))):
                for number, line in enumerate(text.split(b"\n")):
                    words = words_of(line)
                    if words and len(words) >= shortest:
                        rows.append(row)
                        numbers.append(number)
                        hashes.append(whole(words))
                        keys.append(ends_of(words) if len(words) >= FUZZY else None)
            if rows:
                own = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "text_hash", "doc")]
                yield pa.record_batch([*own, pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "doc", "line", "hash", "ends"])

    return docs.mapInArrow(run, f"doc_id long, text_hash long, doc {_DECIMAL}, line int, hash long, ends array<long>")


def _variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, key, kind, words of the wanted lines (doc, lines); kind 0: replacement, 1: variant, 2: whole line.

    words is null but for kind 2. Documents are moved only if the list of wanted ones is too long to send to each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            at, out, seen = [], ([], [], [], []), set()
            docs_ = batch.column("doc").to_pylist()
            for row, (doc, text, numbers) in enumerate(zip(docs_, texts_of(batch.column("text")), batch.column("lines").to_pylist(), strict=True)):
                lines = text.split(b"\n")
                for number in numbers:
                    if (doc, number) in seen or number >= len(lines):
                        continue
                    seen.add((doc, number))
                    words = words_of(lines[number])
                    rows = [(whole(words), 2, b" ".join(words)), *((key, kind, None) for pair in variants(words) for kind, key in enumerate(pair))]
                    at.extend([row] * len(rows))
                    out[0].extend([number] * len(rows))
                    for column, values in zip(out[1:], zip(*rows, strict=True), strict=True):
                        column.extend(values)
            if at:
                columns = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int8(), pa.binary()), strict=True)]
                yield pa.record_batch([batch.column("doc").take(pa.array(at)), *columns], ["doc", "line", "key", "kind", "words"])

    few = wanted.count() <= SENT
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc")
    found = texts.select("doc", "text", "lines").mapInArrow(run, f"doc {_DECIMAL}, line int, key long, kind byte, words binary")
    return found.select(_place().alias("place"), "key", "kind", "words")


def removed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), lines (ascending numbers, from 0) of each document that loses lines."""
    docs = identified(docs)
    lines = written(_lines(docs, shortest), "lines")
    classes = written(lines.groupBy("hash").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies")), "line-classes")
    keys = lines.where(F.col("ends").isNotNull()).select("hash", F.explode("ends").alias("end"))
    shared = keys.groupBy("end").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most").select("end")
    near = keys.join(shared, "end", "left_semi").select("hash").distinct()
    at = written(classes.join(near, "hash").select("hash", "first"), "near-lines")
    line_of = F.pmod("first", _number(_LINES)).cast("int")
    doc_of = F.floor((F.col("first") - line_of) / _number(_LINES)).cast(_DECIMAL)
    wanted = written(at.groupBy(doc_of.alias("doc")).agg(F.sort_array(F.collect_list(line_of)).alias("lines")), "wanted")
    emitted = written(_variants(docs, wanted), "line-variants")
    placed = emitted.select("place", "key", "kind")
    # The earliest whole line, variant and replacement of each key that more than one line has.
    least = placed.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("place"))).alias(f"least{k}") for k in (0, 1, 2)], F.min("place").alias("one"), F.max("place").alias("other"))
    least = least.where("one <> other").drop("one", "other")
    by = F.when(F.col("kind") == 0, F.col("least0")).when(F.col("kind") == 1, F.col("least2")).otherwise(F.col("least1"))
    matched = written(placed.join(least, "key").withColumn("by", by).where("by < place").groupBy("place").agg(F.min("by").alias("by")), "line-matches")
    # Verify on the words themselves.
    texts = emitted.where("kind = 2").select("place", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [word_distance(a.split(b" "), b.split(b" "), 1) <= 1 for a, b in zip(batch.column("words").to_pylist(), batch.column("by_words").to_pylist(), strict=True)]
            yield batch.select(["place"]).filter(pa.array(good, pa.bool_()))

    paired = matched.join(texts, "place").join(texts.select(F.col("place").alias("by"), F.col("words").alias("by_words")), "by")
    verified = paired.select("place", "words", "by_words").mapInArrow(verify, f"place {_DECIMAL}")
    near = at.join(verified.withColumnRenamed("place", "first"), "first").select("hash", F.lit(True).alias("near"))
    # All of a class but its first go; the first goes too if an earlier class matches it.
    state = classes.join(near, "hash", "left").where((F.col("copies") > 1) | F.col("near")).select("hash", "first", F.coalesce("near", F.lit(False)).alias("near"))
    state = written(state, "line-states")
    gone = lines.select("doc_id", "text_hash", "doc", "line", "hash").join(state, "hash").where(F.col("near") | (_place() != F.col("first")))
    # Distinct numbers: a repeated row of the same document is the same document.
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows and columns of docs with `text` rid of repeated lines, and `removed_lines` (null: none), `n_lines`.

    n_lines counts the lines of the text before. A text that loses nothing is kept byte for byte.
    """
    gone = removed_lines(docs, shortest).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__gone"), F.col("lines").alias("removed_lines"))
    rest = docs.drop("removed_lines", "n_lines").withColumn("__hash", F.xxhash64("text"))
    joined = rest.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__gone")), "left").drop("__hash", "__id", "__gone")
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("removed_lines", i)), "\n")
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("n_lines", F.size(split)).withColumn("text", text)


def left_blank() -> Column:
    """True where every word of the text went with removed lines, for the columns that dedup_lines gives."""
    return F.col("removed_lines").isNotNull() & (F.trim(F.coalesce(F.col("text"), F.lit(""))) == "")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


__all__ = ["dedup_lines", "digest", "left_blank", "removed_lines", "word_distance"]
