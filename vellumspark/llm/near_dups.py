"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles (operator 8).

A text is a weighted set of its shingles of SHINGLE words (A-Z lowered, split at ASCII white space and punctuation; a
shorter text is one shingle): weight = count * idf, idf = 1 + DAMP * ln((N + 1) / (df + 1)) / ln(N + 1). df counts the
different texts that have the shingle, of N in the table: copies count once, and neither partitions nor files matter. The
idf is scaled by its largest value: else a group of thousands of near copies would be dissolved by its own frequency, as
what they share would weigh a tenth of what an edit puts in.
Two texts are linked if their weighted Jaccard similarity is SIMILAR or more; classes are connected components.

1. Documents are dealt by row into blocks of about BLOCK_BYTES of text, so that no key makes a block large. Each block
   is told which of its rows are the first of their text in the table, sends the shingle hashes of those, sorted and
   delta-coded with their counts, to the owner of their hash range, and gets back those in more than one text with their df.
2. Only a text that owes SIMILAR of its weight to such shared shingles can have a partner; this loses no link, and only
   such texts are sampled: BANDS bands of ROWS samples each. Copies (equal words) are one text from here on.
3. Texts that share a band are candidates. No group is turned into its pairs: first, the leader of a band's group (the
   text with the most common shingles) is compared with its members, and classes are joined. Groups that still are of
   several classes are compared in full, in pairs of chunks of CHUNK texts, each a product of matrices in one task, of
   which only links that join classes come out. So every candidate pair is either compared or already in one class.
4. A comparison is the exact weighted Jaccard similarity of both shingle sets. What a Python worker holds at once is
   bounded by bytes: pairs come in batches of PAIR_BYTES at most (or one pair), chunks have about CHUNK_BYTES.

Defined results: texts without words (null, empty, blank) are copies of each other; rows that repeat are copies; a class
is named after its first row in the order of doc_id (null last), then of a hash of the text, so a null doc_id is never a
class id unless the class has no other; an empty table gives an empty result; other columns are ignored. docs should be
a table (or a checkpoint), as its rows are dealt by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import batches_of, shuffle_partitions, texts_of, written
from vellumspark.llm.components import relabelled

SHINGLE, SIMILAR, DAMP = 5, 0.8, 0.5
BANDS, ROWS = 14, 4
BLOCK_BYTES = 8 << 20
#: A leader's comparisons in one task.
SPREAD = 256
#: Texts on either side of a block of comparisons; so many digests at most are named to every task.
CHUNK, SENT = 256, 1_000_000
#: Bytes of shingle sets in a batch of pairs, and in a chunk; comparing two chunks takes about five times their bytes besides them.
PAIR_BYTES, CHUNK_BYTES = 8 << 20, 12 << 20
#: A-Z are lowered and ASCII punctuation is white space, so that a moved comma or a new sentence changes no word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The text's distinct shingle hashes, ascending, their counts, and a digest of its words."""
    words = text.translate(_WORDS).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    digest = xxhash.xxh3_128_digest(h.tobytes())
    n = len(h)
    if not n:
        return np.array([_EMPTY]), np.ones(1, np.int64), digest
    out = np.zeros(max(1, n - size + 1), np.uint64)
    for j in range(min(size, n)):
        out = out * _P + h[j : j + len(out)]
    return *np.unique(mixed(out + np.uint64(min(size, n))), return_counts=True), digest


def packed(values: np.ndarray) -> bytes:
    """Ascending 48-bit values as the first and 32-bit steps where these suffice, else whole."""
    if len(values) > 1 and (steps := np.diff(values)).max() < 1 << 32:
        return b"\1" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\0" + values.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.uint64, offset=1)
    first = np.frombuffer(data, np.uint64, count=1, offset=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def weights(counts: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """df: how many of `total` different texts have the shingle."""
    return counts * (1 + DAMP * np.log((total + 1) / (df + 1)) / max(np.log(total + 1), 1e-9))


class Sampler:
    """Consistent weighted samples: equal with the probability of the weighted Jaccard similarity.

    For a shingle of weight w and a sample i: r and c are Gamma(2, 1) and b uniform, all from a hash of shingle and i;
    t = floor(ln w / r + b), ln a = ln c - r (t - b) - r. The shingle with the least a and its t are the sample.
    """

    def __init__(self, samples: int = BANDS * ROWS):
        x = np.linspace(1e-4, 40, 400_001)
        at = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.gamma = np.interp(at, 1 - (1 + x) * np.exp(-x), x)
        self.log_gamma = np.log(self.gamma)
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * _P)

    def __call__(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        best = np.full(len(self.seeds), np.inf)
        out = np.zeros(len(self.seeds), np.uint64)
        every = np.arange(len(self.seeds))
        for start in range(0, len(hashes), 2048):
            h, w = hashes[start : start + 2048], np.log(weight[start : start + 2048])[:, None]
            x = mixed(h[:, None] ^ self.seeds[None, :])
            r = self.gamma[(x & np.uint64(0xFFFF)).astype(np.int64)]
            c = self.log_gamma[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
            b = (x >> np.uint64(32)).astype(np.float64) / 2.0**32
            t = np.floor(w / r + b)
            a = c - r * (t - b) - r
            least = a.argmin(axis=0)
            value = a[least, every]
            sample = mixed(h[least] * _P + t[least, every].astype(np.int64).astype(np.uint64))
            better = value < best
            best[better], out[better] = value[better], sample[better]
        return out

    def bands(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rows = self(hashes, weight).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64) * _Q
        for j in range(ROWS):
            key = mixed(key * _P + rows[:, j])
        return key.view(np.int64)


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights)."""
    ha, hb = (np.frombuffer(x[0], np.uint64) for x in (a, b))
    wa, wb = (np.frombuffer(x[1], np.float32).astype(np.float64) for x in (a, b))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    least = np.minimum(wa[i], wb[j]).sum()
    most = wa.sum() + wb.sum() - least
    return float(least / most) if most else 1.0


def sampled_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest of each row, and for a text that can have a partner bands, hashes, weights (once in each block)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = max(shuffle_partitions(docs.sparkSession), -(-(size[1] or 0) // BLOCK_BYTES))
    block_of = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block_of)
    # The first row of each different text; a text that many rows have is one row before it moves.
    firsts = rows.groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).agg(F.min("row").alias("row")).select("row")
    firsts = written(firsts, "first-rows")
    total = firsts.count()
    firsts = firsts.withColumn("block", block_of)
    schema = "part int, block int, hashes binary, df binary"

    def send(block: pa.Table, first: pa.Table) -> pa.Table:
        wanted = np.isin(block.column("row").to_numpy(), first.column("row").to_numpy()) if first.num_rows else np.zeros(block.num_rows, bool)
        own = [np.unique(shingles(t)[0] >> np.uint64(16)) for t in texts_of(block.column("text").filter(pa.array(wanted)).combine_chunks())]
        found: list[tuple] = []
        if own:
            values, df = np.unique(np.concatenate(own), return_counts=True)
            del own
            part = ((values >> np.uint64(16)) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(part)) + 1
            found = [(int(part[a]), packed(values[a:b]), df[a:b].astype(np.uint32).tobytes()) for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True)]
        at = block.column("block")[0].as_py() if block.num_rows else -1
        return pa.table([pa.array([x[0] for x in found], pa.int32()), pa.array([at] * len(found), pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())], ["part", "block", "hashes", "df"])

    def count(part: pa.Table) -> pa.Table:
        each = [unpacked(x) for x in part.column("hashes").to_pylist()]
        df = np.concatenate([np.frombuffer(x, np.uint32) for x in part.column("df").to_pylist()])
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        whole = np.bincount(at, weights=df)
        df = np.where(whole > 1, whole, 0).astype(np.uint32)[at]
        ends = np.cumsum([len(x) for x in each])
        out: list[tuple] = []
        for block, values, end in zip(part.column("block").to_pylist(), each, ends, strict=True):
            own = df[end - len(values) : end]
            if own.any():
                out.append((block, packed(values[own > 0]), own[own > 0].tobytes()))
        return pa.table([pa.array([0] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["part", "block", "hashes", "df"])

    sampler: list[Sampler] = []

    def sample(block: pa.Table, shared: pa.Table) -> pa.Table:
        if not sampler:
            sampler.append(Sampler())
        known, df = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        if shared.num_rows:
            known = np.concatenate([unpacked(x) for x in shared.column("hashes").to_pylist()])
            df = np.concatenate([np.frombuffer(x, np.uint32) for x in shared.column("df").to_pylist()])
            order = np.argsort(known)
            known, df = known[order], df[order]
        done: set[bytes] = set()
        out: list[list] = [[] for _ in range(6)]
        for text in texts_of(block.column("text").combine_chunks()):
            hashes, counts, digest = shingles(text)
            out[0].append(digest)
            bands = own = weight = mass = centre = None
            if digest not in done and len(known):
                at = np.minimum(np.searchsorted(known, hashes >> np.uint64(16)), len(known) - 1)
                common = known[at] == hashes >> np.uint64(16)
                w = weights(counts, np.where(common, df[at], 1), total)
                if w[common].sum() >= SIMILAR * w.sum() * (1 - 1e-6):
                    done.add(digest)
                    bands, own, weight = sampler[0].bands(hashes, w), hashes.tobytes(), w.astype(np.float32).tobytes()
                    mass = float(w.astype(np.float32).astype(np.float64).sum())
                    # How common the text's shingles are: the text of which others are edited copies has the most.
                    centre = float(np.log(np.where(common, df[at], 1)).mean())
            for column, x in zip(out[1:], (bands, own, weight, mass, centre), strict=True):
                column.append(x)
        return pa.table([block.column("doc_id").combine_chunks(), block.column("text_hash").combine_chunks(), pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.float64())], ["doc_id", "text_hash", "digest", "bands", "hashes", "weights", "total", "centre"])

    pieces = dealt.select("block", "row", "text").groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(send, schema)
    shared = pieces.groupBy("part").applyInArrow(count, schema).select("block", "hashes", "df")
    return dealt.drop("row").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(sample, "doc_id long, text_hash long, digest binary, bands array<long>, hashes binary, weights binary, total double, centre double")


def thin_files(spark: SparkSession) -> int:
    """Files of a table of digests or links at most: an eighth of a shuffle's partitions, as its rows are short."""
    return -(-shuffle_partitions(spark) // 8)


def thin(df: DataFrame, name: str) -> DataFrame:
    return written(df.coalesce(thin_files(df.sparkSession)), name)


def named(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose digest is among `digests` (distinct); these are sent to each task if they are few enough."""
    return rows.join(F.broadcast(digests) if digests.count() <= SENT else digests, "digest", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of digests that are similar, as a table; a leader of many pairs is spread over tasks by their number.

    A leader's set comes again with each of its pairs, so a batch has as many pairs as PAIR_BYTES hold of the largest set.
    """
    most = texts.agg(F.max("size")).first()[0] or 1
    ends = thin(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), "ends")
    texts = named(texts, ends)
    hot = thin(pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / SPREAD).cast("int").alias("parts")), "leaders")
    salted = pairs.join(hot, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("parts"))).drop("parts")
    left = texts.join(hot.withColumnRenamed("a", "digest"), "digest").select(F.col("digest").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = texts.select(F.col("digest").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    both = salted.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "ha", "wa", "hb", "wb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ha", "wa", "hb", "wb")]
            like = [similarity((ha, wa), (hb, wb)) for ha, wa, hb, wb in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array([x >= SIMILAR - 1e-6 for x in like], pa.bool_()))

    with batches_of(pairs.sparkSession, max(1, PAIR_BYTES // (2 * most))):
        # A shuffle gathers the few links, so that tasks that compare write no files.
        return thin(both.mapInArrow(compare, "a binary, b binary").distinct(), "verified")


def block_links(sets: list[tuple[np.ndarray, np.ndarray]], labels: list, rows: list[int], columns: list[int]) -> list[tuple[int, int]]:
    """Pairs (row, column) that are similar and join labels that aren't joined yet; all of them are compared.

    Weights are count * idf with one idf for a shingle, so a text is a set of (shingle, rank of the weight among those
    that the shingle has here) and the shared weight of all pairs is one product of matrices over shingles that two texts
    share: sum of min = sum over the steps between a shingle's weights of step * both reach it.
    """
    everything = np.concatenate([h for h, _ in sets])
    names, at, n = np.unique(everything, return_inverse=True, return_counts=True)
    values = np.concatenate([w for _, w in sets])
    of = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    shared = n[at] > 1
    at, values, of = at[shared], values[shared], of[shared]
    column = np.cumsum(n > 1) - 1
    at = column[at]
    total = np.array([w.sum() for _, w in sets])
    common = np.zeros((len(rows), len(columns)))
    place_r, place_c = (np.full(len(sets), -1) for _ in range(2))
    place_r[rows], place_c[columns] = np.arange(len(rows)), np.arange(len(columns))
    # The steps of each shingle's weights: mostly one, as a count of 1 is usual.
    low = np.zeros(int(column[-1]) + 1 if len(column) else 0)
    left = values.copy()
    while len(at):
        step = np.full(len(low), np.inf)
        np.minimum.at(step, at, left)
        step[~np.isfinite(step)] = 0
        for start in range(0, len(low), 4096):
            inside = (at >= start) & (at < start + 4096)
            r, c = inside & (place_r[of] >= 0), inside & (place_c[of] >= 0)
            a, b = np.zeros((len(rows), 4096), np.float32), np.zeros((len(columns), 4096), np.float32)
            a[place_r[of[r]], at[r] - start] = step[at[r]]
            b[place_c[of[c]], at[c] - start] = 1
            common += a @ b.T
        left = left - step[at]
        more = left > 1e-6
        at, left, of = at[more], left[more], of[more]
    like = common / (total[rows][:, None] + total[columns][None, :] - common)
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(like >= SIMILAR - 1e-4), strict=True):
        x, y = rows[i], columns[j]
        if root(labels[x]) != root(labels[y]):
            # Products of float32 may miss by rounding; what is near the bound is compared exactly.
            exact = similarity((sets[x][0].tobytes(), sets[x][1].astype(np.float32).tobytes()), (sets[y][0].tobytes(), sets[y][1].astype(np.float32).tobytes()))
            if exact >= SIMILAR - 1e-6:
                parent[root(labels[x])] = root(labels[y])
                out.append((x, y))
    return out


def blocks_compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the members (key, digest, label) of each key, all compared, in pairs of chunks of CHUNK texts.

    A member goes once to each pair of its chunk; pairs of texts aren't rows, only new links come out. Long texts make
    smaller chunks, by CHUNK_BYTES.
    """
    n, size = F.count(F.lit(1)), F.sum("size")
    chunks = members.join(texts.select("digest", "size"), "digest").groupBy("key").agg(F.least(n, F.ceil(F.greatest(n / CHUNK, size / CHUNK_BYTES))).cast("int").alias("chunks"))
    own = members.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "label")
    filled = dealt.join(named(texts, thin(members.select("digest").distinct(), "open")), "digest").select("key", "i", "j", "own", "digest", "label", "hashes", "weights")

    def compare(group: pa.Table) -> pa.Table:
        digests, labels, own_ = (group.column(c).to_pylist() for c in ("digest", "label", "own"))
        sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32).astype(np.float64)) for h, w in zip(group.column("hashes").to_pylist(), group.column("weights").to_pylist(), strict=True)]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rows, columns = ([k for k, x in enumerate(own_) if x == side] for side in (i, j))
        found = block_links(sets, labels, rows, columns) if rows and columns else []
        return pa.table([pa.array([digests[x] for x, _ in found], pa.binary()), pa.array([digests[y] for _, y in found], pa.binary())], ["a", "b"])

    return filled.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def text_classes(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label of the digests of members (key, digest, total, centre): connected components of the similar ones."""
    files = thin_files(members.sparkSession)
    labels = thin(members.select(F.col("digest").alias("node"), F.col("digest").alias("label")).distinct(), "labels")
    lead = members.groupBy("key").agg(F.max(F.struct("centre", "digest", "total")).alias("lead")).select("key", F.col("lead.digest").alias("a"), F.col("lead.total").alias("total_a"))
    near = (F.col("digest") != F.col("a")) & (F.least("total", "total_a") >= F.greatest("total", "total_a") * (SIMILAR - 1e-6))
    pairs = members.join(lead, "key").where(near).select("a", F.col("digest").alias("b")).distinct()
    labels = relabelled(labels, verified(thin(pairs, "pairs"), texts), files)
    now = members.select("key", "digest").join(labels.withColumnRenamed("node", "digest"), "digest")
    unsettled = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y and n > 2").select("key")
    rest = written(now.join(unsettled, "key", "left_semi"), "unsettled")
    return labels if rest.isEmpty() else relabelled(labels, thin(blocks_compared(rest, texts).distinct(), "block-links"), files)


def _class_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest of each row, and for each digest first (the first row of its class: doc_id, text_hash), class_size, class_texts."""
    rows = written(sampled_texts(docs), "sampled")
    sampled = rows.where(F.col("bands").isNotNull()).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("bands", "total", "centre")])
    keyed = written(sampled.select("digest", "total", "centre", F.explode("bands").alias("key")), "bands")
    shared = keyed.groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("key")
    members = written(keyed.join(shared, "key", "left_semi"), "members")
    partners = thin(members.select("digest").distinct(), "partners")
    texts = named(rows.where(F.col("bands").isNotNull()).select("digest", "hashes", "weights"), partners).groupBy("digest").agg(F.first("hashes").alias("hashes"), F.first("weights").alias("weights"))
    texts = texts.withColumn("size", (F.octet_length("hashes") + F.octet_length("weights")).cast("long"))
    labels = text_classes(members, written(texts, "texts"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    each = rows.groupBy("digest").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("copies"))
    each = written(each.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest")), "digests")
    whole = each.groupBy("label").agg(F.min("least").alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("class_texts"))
    return rows.select("doc_id", "digest"), each.join(whole, "label").select("digest", "first", "class_size", "class_texts")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size, class_texts (different texts) of each row of docs."""
    rows, of = _class_rows(docs)
    return rows.join(of, "digest").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "class_texts")


def without_near_dups(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, without all but the first row of each class; of repeated rows one stays.

    A row is known by its id and its text, so that rows that share an id or have none aren't taken for each other.
    """
    _, of = _class_rows(docs)
    kept = written(of.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__kept")).distinct(), "kept")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    # The window finds its rows where the join has put them, and keeps one of a row's repeats before they move.
    same = Window.partitionBy("doc_id", "__text").orderBy("__text")
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__kept")), "left_semi").withColumn("__n", F.row_number().over(same))
    return rows.where("__n = 1").select(*docs.columns)
