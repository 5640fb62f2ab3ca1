"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tables import SF
from vellumspark.llm import hard_negatives, queries, resampling, simhash
from vellumspark.llm.common import chunked


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("carry", [0, 1, 2])
def test_chunks_own_every_start_once(carry):
    rng = random.Random(carry)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", " ", "  ", "longer"]) for _ in range(rng.randrange(60))).encode()
        runs = []
        for piece, owned in chunked(text, rng.randrange(1, 12), carry):
            words, own = piece.split(), len(piece[:owned].split())
            runs += [words[i : i + carry + 1] for i in range(own)]
        words = text.split()
        assert runs == [words[i : i + carry + 1] for i in range(len(words))]


def brute_resampled(docs, target, most, buckets, percent, least):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            for b in features(text):
                counts[b] += 1
    S, T = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= least)
    drawn = [x[1:] for x in fit[: len(fit) * percent // 100]]
    return sorted(map(tuple, out), key=str), sorted(drawn)


@pytest.mark.parametrize("most,chunk", [(1, 1 << 16), (3, 1 << 16), (3, 64)])
def test_resampling_is_the_brute_force(spark, odd, most, chunk):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    target = [(1, "five six seven eight"), (2, None), (3, "un deux trois word word")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = resampling.resampled(frame, spark.createDataFrame(target, "item_id long, text string"), percent=40, least_words=5, most=most, buckets=97, chunk=chunk).collect()
    want, drawn = brute_resampled(docs, target, most, 97, 40, 5)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got], key=str) == want
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
    assert sorted(r[2:] for r in ranked) == drawn


def test_resampling_of_empty_tables_and_drawn_rows(spark, odd, none):
    target = spark.createDataFrame([(1, "five six")], "item_id long, text string")
    assert resampling.resampled(none, target).count() == 0
    assert resampling.resampled(odd, target.where("false")).count() == odd.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = resampling.drawn(docs, target, percent=30)
    ranks = resampling.resampled(docs, target, percent=30).where("rank is not null")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in ranks.select("doc_id").collect())


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90, anchors=lambda r: r[0] % 10 == 0):
    known = [(k, i, la, [math.floor(256 * x) for x in v]) for k, (i, la, v) in enumerate(rows) if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(r[3]) for r in known), default=0)
    known = [(k, i, la, v + [0] * (size - len(v))) for k, i, la, v in known]
    out = []
    for k, i, la, v in known:
        if not anchors((i, la)):
            continue
        score = lambda r: sum(a * b for a, b in zip(v, r[3], strict=True))  # noqa: E731, B023
        near = sorted((-score(r), r[1]) for r in known if r[0] != k and r[2] == la)[:positives]
        far = sorted((-score(r), r[1]) for r in known if r[2] != la)
        for p, pid in near:
            inside = [x for x in far if low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, pid, n + 1, nid, -p, -s) for n, (s, nid) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("cells,block,anchor_block", [(64, 65536, 2048), (4, 50, 3), (2, 7, 1000)])
def test_hard_negatives_are_the_brute_force(spark, cells, block, anchor_block):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(4, 6))
    rows = [(i, int(i % 4), [float(np.float32(x)) for x in centre[i % 5 % 4] + rng.normal(size=6) / 2]) for i in range(240)]
    rows += [(300 + i, i % 2, rows[3][2]) for i in range(30)]  # ties
    rows += [rows[0], rows[0], (1000, None, rows[1][2]), (1010, 1, None), (1020, 1, [1.0, None]), (1030, 1, [float("nan")] * 6), (1040, 1, [float("inf")] * 6), (None, 1, rows[1][2]), (1050, 2, []), (1060, 2, [0.5]), (1070, 9, rows[5][2])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, cells=cells, block=block, anchor_block=anchor_block)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_hard_negatives_of_empty_tables_and_large_components(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    rows = spark.createDataFrame([(0, 1, [3e38, 1.0]), (1, 1, [1e30, 0.0]), (2, 2, [0.5 * 2**20, 0.0])], schema)
    found = hard_negatives.hard_negatives(rows, F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id, r.positive_score) for r in found] == [(1, 2, 2**56)]


def brute_fingerprint(text, size=3):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, distance=2):
    least = {p: p for p in prints}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= distance:
            least[root(a)] = root(b)
    of = {}
    for p, i in zip(prints, ids, strict=True):
        of.setdefault(root(p), []).append(i)
    return [min((i for i in of[root(p)] if i is not None), default=None) for p in prints]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 18])
def test_fingerprints_do_not_depend_on_chunks(chunk):
    for text in ("", "  \t\n ", "One", "One two", " One\x0btwo\x0cthree FOUR\rfive ", "a " * 500 + "ÉLAN é\x85b", "x" * 90 + " y z w v"):
        assert simhash.fingerprint(text.encode(), chunk=chunk) == brute_fingerprint(text)


def test_simhash_query_is_the_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{p:016x}" for p in prints], brute_components(prints, [r.doc_id for r in rows]), strict=True), strict=True))
    got = queries.op13_simhash(spark, SF).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_links_join_dense_groups(spark):
    """Chains and clouds of fingerprints, of which many share a key: components as of all pairs."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for start in (0, 1 << 63, rng.getrandbits(64)):
        at = start
        for _ in range(40):  # a chain of steps of two bits
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(at)
        base = rng.getrandbits(64)
        prints |= {base ^ rng.getrandbits(9) for _ in range(400)}  # many in the same low bits: more than SMALL in a group
        prints |= {start ^ 1 << b for b in (0, 20, 40, 63)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long")).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() >= 1 for r in found)
    prints = sorted(prints)
    want = brute_components(prints, prints)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
        parent[max(a, b)] = min(a, b)
    assert [root(p) for p in prints] == want


def test_simhash_on_odd_rows(spark, odd, none):
    assert simhash.components(none).count() == 0 and simhash.without_near_dups(none).columns == none.columns
    rows = odd.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = brute_components(prints, [r.doc_id for r in rows])
    got = simhash.components(odd)
    assert set(odd.columns) - {"text"} < set(got.columns)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] % (1 << 64))
    assert sorted([(r.doc_id, r.bits % (1 << 64), r.component_id) for r in got.collect()], key=key) == sorted(zip([r.doc_id for r in rows], prints, want, strict=True), key=key)
    kept = simhash.without_near_dups(odd).collect()
    groups = {}
    for r, p, c in zip(rows, prints, want, strict=True):
        groups.setdefault(p if c is None else c, []).append(r.doc_id)
    assert len(kept) == len(groups) and kept[0].__fields__ == odd.columns
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert simhash.without_near_dups(lone).count() == 1
