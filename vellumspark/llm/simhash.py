"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks (operator 13).

A text's features are its runs of SHINGLE words (A-Z lowered, split at ASCII white space, joined by one space), repeats
counted; a text of fewer words is one feature. A fingerprint has 64 bits, each set if it is set in over half of the
features' XXH64 (seed 42). Fingerprints link at DISTANCE differing bits or fewer.

Fingerprints are split into BLOCKS blocks of bits. Of two that link, at most DISTANCE blocks differ, so they share some
choice of BLOCKS - DISTANCE blocks exactly: each different fingerprint goes once to each such choice (15 of them, of 42
bits or more), and those that share it are compared. What shares a choice differs in 22 bits at most, so a group has a
bound however large the table is. A group isn't turned into its pairs: small ones are compared by offsets of the sorted
run, larger ones look up the 1 + 22 + 231 neighbours of each member, and only links that join what isn't joined yet come
out. So no link is lost for the components, and work is linear in a group's size.

Defined results: a null or empty text, or one without words, has the fingerprint zero, which links like any other; rows
that repeat share a fingerprint; a component's id is its least doc_id, null if it has none; an empty table gives an empty
result; other columns are ignored, and `without_near_dups` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import arrow_map, chunked, shuffle_partitions, texts_of, written
from vellumspark.llm.components import relabelled

SHINGLE, DISTANCE, BLOCKS, SEED = 3, 2, 6, 42
#: Bytes of a text that are cut into words at once.
CHUNK = 1 << 18
#: Members up to which a group is compared by offsets.
SMALL = 32
_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, size: int = SHINGLE, chunk: int = CHUNK) -> int:
    """The 64 bits of a text; memory is that of a chunk."""
    counts, total = np.zeros(64, np.int64), 0
    for first, (piece, owned) in enumerate(chunked(text.translate(_WORDS).strip(), chunk, size - 1)):
        words = piece.split()
        own = len(words) if owned >= len(piece) else len(piece[:owned].split())
        line = b" ".join(words)
        if first == 0 and words and len(words) < size:
            shingles = [line]
        else:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
            n = min(own, len(words) - size + 1)
            shingles = [line[a:b] for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=False)] if n > 0 else []
        hashes = np.fromiter(map(_hash, shingles), np.uint64, len(shingles))
        total += len(hashes)
        for at in range(0, len(hashes), 8192):
            counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with the column bits: the fingerprint as a signed 64-bit number."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names if c != "text"], pa.array(found)], [*[c for c in names if c != "text"], "bits"])

    kept = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c != "text")
    return arrow_map(docs.withColumn("text", F.coalesce("text", F.lit(""))), run, f"{kept}, bits long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits of each choice of blocks that fingerprints within the distance can share."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, blocks - distance)]


def joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of n places after the links a-b have joined them: the least place of each component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = a[apart], b[apart]
    return label


def run_links(bits: np.ndarray, run: np.ndarray, masks: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each place the least place that links join it with; bits ascend (unsigned) within a run, runs follow each other.

    masks has for each place the bits that its run shares.
    """
    n = len(bits)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    size = np.repeat(sizes, sizes)
    for offset in range(1, min(SMALL, int(sizes.max(initial=1)))):
        a = np.flatnonzero((run[:-offset] == run[offset:]) & (size[:-offset] <= SMALL))
        near = np.bitwise_count(bits[a] ^ bits[a + offset]) <= distance
        label = joined(n, a[near], a[near] + offset, label)
    for start, count in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = bits[start : start + count]
        free = [np.uint64(1 << b) for b in range(64) if not int(masks[start]) >> b & 1]
        part = np.arange(count)
        for k in range(1, distance + 1):
            for flipped in combinations(free, k):
                other = own ^ np.bitwise_or.reduce(np.array(flipped))
                at = np.minimum(np.searchsorted(own, other), count - 1)
                a = np.flatnonzero((own[at] == other) & (other > own))
                part = joined(count, a, at[a], part)
        label[start : start + count] = start + part
    return label


def links(fingerprints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between the different fingerprints (bits) that join all that are within the distance, and nothing else."""
    masks = np.array(block_masks(blocks, distance), np.uint64)
    signed = masks.view(np.int64).tolist()
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("shared")) for k, m in enumerate(signed)])
    dealt = fingerprints.select("bits", F.explode(keys).alias("key")).select("key.choice", "key.shared", "bits")
    dealt = dealt.repartition(shuffle_partitions(fingerprints.sparkSession), "choice", "shared").sortWithinPartitions("choice", "shared", "bits")

    def found(choice: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        own = masks[choice]
        key = bits & own
        # Fingerprints came signed; a run is ascending unsigned as well once its halves are in order.
        order = np.lexsort((bits, key, choice))
        bits, choice, key, own = bits[order], choice[order], key[order], own[order]
        fresh = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]) if len(bits) else np.zeros(0, bool)
        label = run_links(bits, np.cumsum(fresh), own, distance)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(bits[label[at]].view(np.int64)), pa.array(bits[at].view(np.int64))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time: the last group of a batch waits for the next one."""
        choice, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            choice = np.concatenate([choice, batch.column("choice").to_numpy(zero_copy_only=False).astype(np.int64)])
            bits = np.concatenate([bits, batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(bits) < 50_000:
                continue
            key = bits & masks[choice]
            other = np.flatnonzero((choice != choice[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found(choice[:cut], bits[:cut])
                choice, bits = choice[cut:], bits[cut:]
        yield found(choice, bits)

    return dealt.select("choice", "bits").mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The columns of docs but its text, bits, component_id, copies (rows that share the fingerprint) and label of each row.

    label is a fingerprint of the component, which names it even if none of its rows has an id.
    """
    spark = docs.sparkSession
    rows = written(fingerprinted(docs, size), "fingerprints")
    each = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "different")
    labels = each.select(F.col("bits").alias("node"), F.col("bits").alias("label"))
    labels = relabelled(labels, written(links(each.select("bits"), blocks, distance), "simhash-links"))
    known = each.join(labels.withColumnRenamed("node", "bits"), "bits")
    whole = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(known.join(whole, "label").select("bits", "component_id", "copies", "label"), "components")
    # Fingerprints of more than a share of all rows are few, as shares add up to one: those go to every task.
    parts = shuffle_partitions(spark)
    share = max(1, rows.count() // (4 * parts))
    hot = F.broadcast(named.where(F.col("copies") > share))
    return rows.join(hot, "bits").unionByName(rows.join(hot, "bits", "left_anti").join(named, "bits"))


def hex_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def without_near_dups(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, without all but one of each component: the first by doc_id (null last), then text.

    Of rows that repeat in all of doc_id and text one stays.
    """
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__text").alias("text"))
    found = components(keyed.select("doc_id", "__text", "text"))
    first = found.groupBy("label").agg(F.min(place).alias("first"))
    kept = written(first.select(F.col("first.doc_id").alias("__id"), F.col("first.text").alias("__kept")).distinct(), "kept")
    same = Window.partitionBy("doc_id", "__text").orderBy("__text")
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__kept")), "left_semi")
    return rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*docs.columns)
