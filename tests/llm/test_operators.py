"""The corpus operators against brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tables import SF
from vellumspark.llm import components, decontamination, fingerprints, language_id, language_model, line_dedup, mixing, near_dups, quality, sampling, token_counts, toxicity
from vellumspark.llm.common import hash_words, held_out, searched

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# Token counts


def test_token_counts_are_the_librarys_and_the_cache_is_used(spark, docs, texts, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, cache).collect()}
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 512)
    stored = spark.read.parquet(cache).count()
    assert stored == len(set(texts.values()))
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("quite new <|endoftext|> text")))
    assert token_counts.count_tokens(more, path, cache).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == stored + 1


def test_long_texts_are_cut_where_no_token_is(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = " ".join(texts.values())[:60_000] + " <|endoftext|> end"
    pieces = token_counts.parts(long, 1_000)
    assert "".join(pieces) == long and len(pieces) > 20
    assert sum(len(library.encode(p, add_special_tokens=False)) for p in pieces) == len(library.encode(long, add_special_tokens=False))


def test_token_counts_of_odd_rows(odd, none, tmp_path):
    got = token_counts.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/c").collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/d").count() == 0
    model = token_counts.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").collect()
    assert len(model) == 10


# Fingerprints


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_and_likeness(docs, texts):
    ids, got = sorted(texts), {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingles(t), shingles(edited)
        assert abs(got[i].near_edited - len(a & b) / max(1, len(a | b))) < 0.2
        if len(a | b) < fingerprints.K:
            assert got[i].near_edited == pytest.approx(len(a & b) / max(1, len(a | b))) and got[i].n_shingles == len(a)
        assert (got[i].fingerprint == got[ids[(k + 1) % len(ids)]].fingerprint) == (t == following) or a == shingles(following)


def test_sketches_merge_and_decode(spark):
    frame = spark.createDataFrame([("k", list(range(-500, 200, 3))), ("k", list(range(100, 900)))], "key string, s array<long>")
    frame = frame.withColumn("s", fingerprints.sketch(F.col("s")))
    whole = fingerprints.merged_by(frame, "key", "s").first()["s"]
    assert whole == sorted({*range(-500, 200, 3), *range(100, 900)})[: fingerprints.K]
    back = frame.select("s", fingerprints.hashes_of(fingerprints.fingerprint(F.col("s"))).alias("b")).collect()
    assert all(r.s == r.b for r in back)


def test_rows_of_one_id_are_dealt_by_their_texts(spark):
    rows = [(None, f"text number {k} of many that have no id") for k in range(300)] + [(7, f"seven {k}") for k in range(200)] + [(k, f"own {k}") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = [r.text for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    want = collections.Counter()
    for k, t in enumerate(order):
        cut = len(t) // 4
        want[hashlib.sha256((t[: len(t) - cut] + order[(k + 1) % len(order)][:cut]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprints(docs.repartition(7))
    assert collections.Counter(r.edited_sha256 for r in got.collect()) == want


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == 10 and len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 6)} == {""}
    assert fingerprints.fingerprints(none).count() == 0


def test_an_id_that_is_hot_among_others_is_spread(spark):
    """Two thirds of the rows share an id that stands in the middle of others: no task gets them all, and the order is kept."""
    rows = [(i, f"text number {i} of many words") for i in range(300)] + [(150, f"again {k} other words {k % 7}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    paired = fingerprints.with_next(docs).withColumn("at", F.spark_partition_id())
    assert max(r["count"] for r in paired.groupBy("at").count().collect()) < 400
    got = {(r.doc_id, r.text): r.next_text for r in paired.select("doc_id", "text", "next_text").collect()}
    tie = {r.t: r.h for r in docs.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0], tie[r[1]]))
    assert got == {row: order[(k + 1) % len(order)][1] for k, row in enumerate(order)}


def test_binary_search(spark):
    bounds = [-5, 0, 3, 3, 10]
    got = spark.range(-8, 14).select("id", searched(bounds, F.col("id")).alias("n")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


# Language


def test_languages_of_texts_held_out(docs):
    held = held_out(4, 2)
    got = language_id.identify(docs, ~held, held).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out) and all(0 <= r.score <= 1 for r in got)


def test_languages_are_those_of_plain_compression(docs, texts):
    """The least sum of plain zstandard frames against a raw-content dictionary each."""
    held = held_out(4, 2)
    raw = language_id.dictionaries(docs, ~held)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, ~held, held).collect()}
    for i in sorted(texts)[:60]:
        clean = language_id.cleaned(texts[i])
        sizes = {}
        for lang, data in raw.items():
            how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, dict_size=len(data), source_size=language_id.CHUNK, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            parts = [clean[k : k + language_id.CHUNK] for k in range(0, len(clean), language_id.CHUNK)]
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(p)) for p in parts)
        assert got[i] == (min(sizes, key=sizes.get) if clean else "und")


def test_languages_of_odd_rows(odd, none):
    got = language_id.identify(odd, F.lit(True), F.lit(False)).collect()
    assert len(got) == 10 and all((r.lang_pred == "und") == (r.doc_id in (3, 4, 6, 7)) for r in got)
    assert language_id.identify(none, F.lit(True), F.lit(False)).count() == 0


# Language model


def test_scores_are_those_of_counts_in_dictionaries(docs, texts):
    got = {r.doc_id: r for r in language_model.score(docs, held_out(10, 0)).collect()}
    tokens = {i: [w for w in re.split("[\x20\x09-\x0d]+", t.translate(LOWER)) if w] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            s = [None, *t]
            one.update(t), two.update(zip(s, s[1:])), three.update(zip(s, s[1:], s[2:]))
    total, types, (m1, m2) = sum(one.values()), len(one), (language_model.PRIOR[1], language_model.PRIOR[2])
    p1 = lambda w: (one[w] + 0.1) / (total + 0.1 * (types + 1))
    p2 = lambda a, w: (two[a, w] + m1 * p1(w)) / (one[a] + m1)
    p3 = lambda a, b, w: (three[a, b, w] + m2 * p2(b, w)) / (two[a, b] + m2)
    for i, t in tokens.items():
        s = [None, *t]
        want = math.log10(p2(*s[:2])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        base = sum(math.log10(p1(w)) for w in t)
        assert got[i].score == pytest.approx(want) and got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(t), sum(one[w] > 0 for w in t), total, held[i])
    assert sum(got[i].score for i in texts if held[i]) > sum(got[i].base_score for i in texts if held[i])
    assert sum(p3(None, "the", w) for w in one) + 0.1 / (total + 0.1 * (types + 1)) * m1 / (one["the"] + m1) * m2 / (two[None, "the"] + m2) == pytest.approx(1)


def test_texts_that_occur_twice_are_told_apart(spark):
    """A held-out copy of a training text is likelier than other held-out texts, however rare its words."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").where("length(text) > 200")
    rows = {r.doc_id: r for r in language_model.score(docs, held_out(10, 0)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {texts[i] for i, r in rows.items() if not r.held_out}
    gain = lambda r: (r.score - r.base_score) / r.n_tokens
    twice, once = ([gain(r) for i, r in rows.items() if r.held_out and (texts[i] in known) == x] for x in (True, False))
    assert twice and np.mean([x > np.quantile(once, 0.9) for x in twice]) >= 0.9


def test_long_texts_are_read_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 6, n)).encode() for n in rng.integers(0, 40, 60)]
    tokens = language_model.Tokens(texts)
    c1, c2, c3 = tokens.split(tokens.counts(np.arange(60) % 3 > 0))
    automaton = language_model.Automaton((c1 + 0.1) / (c1.sum() + 0.7), c1, tokens.pairs, c2, tokens.triples, c3)
    whole = automaton.read(tokens.ids, tokens.starts, tokens.lengths)
    monkeypatch.setattr(language_model, "SEGMENT", 3)
    assert automaton.read(tokens.ids, tokens.starts, tokens.lengths) == pytest.approx(whole)


def test_what_travels_comes_back():
    rng = np.random.default_rng(2)
    for keys in ([], [0], [5, 6, 1 << 35], [0, (1 << 36) - 1], [0, (1 << 64) - 1], np.unique(rng.integers(0, 1 << 36, 500)).tolist(), np.arange(1000).tolist()):
        assert language_model.unpacked_keys(language_model.packed_keys(np.array(keys, np.uint64))).tolist() == keys
    counts = rng.integers(0, 600, 300)
    counts[[0, 7, 8, 299]] = [0xFFFFFFFE, 0xFFFFFFFF, 1 << 32, 1 << 50]
    for n in (0, 1, 9, 300):
        assert language_model.unpacked_counts(language_model.packed_counts(counts[:n]), n).tolist() == counts[:n].tolist()


def test_language_model_of_odd_rows(odd, none):
    got = language_model.score(odd, held_out(10, 0)).collect()
    assert len(got) == 10 and all(r.n_tokens == 1 for r in got if r.doc_id in (3, 4, 6)) and all(math.isfinite(r.score) for r in got)
    assert language_model.score(none, held_out(10, 0)).count() == 0


# Toxicity and quality


def test_toxicity_is_learned_from_few_words(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choice(plain, 60).tolist()
        if i % 6 == 0:
            w[5 : 5 + 3] = ["vile", "rotten", "scum"][: 1 + i // 6 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scores(docs.withColumn("held_out", held_out(4, 2)), toxicity.train(docs, known.where(~held_out(4, 2))), "held_out").collect()
    wrong = [r for r in got if r.held_out and r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 8
    few = toxicity.train(docs, known.where(~held_out(4, 2)), bound=100)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, few).collect()}
    assert sum(i in kept for i in range(900) if i % 6) > 700 and sum(i in kept for i in range(0, 900, 6)) < 25


def test_classifiers_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.scores(odd.withColumn("k", F.lit(True)), model, "k").count() == 10
    assert toxicity.without_toxic(odd, model, 2.0).columns == odd.columns
    empty = toxicity.train(none, labels.limit(0))
    assert [r.score for r in toxicity.scores(odd.withColumn("k", F.lit(True)), empty, "k").collect()] == pytest.approx([0] * 10)
    assert quality.score(odd, quality.fit(odd, labels)).count() == 10
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0


def test_labels_of_one_class_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (None, "none")], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.lit(5).cast("long"), "k": F.lit(True)})
    for value in (0, 1):
        labels = spark.createDataFrame([(1, value), (2, value)], "doc_id long, toxic int")
        assert {round(r.score) for r in toxicity.scores(docs, toxicity.train(docs, labels), "k").collect()} == {value}
    chosen = sampling.one_row_each(docs.select("doc_id", "text", F.lit(1).alias("label")), 6)
    assert sorted((r.doc_id or 0) for r in chosen.collect()) == [0, 1, 2] and all(len(r.text) <= 6 for r in chosen.collect())


def test_training_is_ftrl_proximal(spark):
    """The fitted weights against the algorithm on plain dictionaries, one coordinate at a time."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(words, 8).tolist() + ["bad"] * (i % 3 == 0))) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    slots, weights, intercept = toxicity.train(docs, labels)
    order = [r.doc_id for r in sampling.labelled_sample(labels, "toxic", 99)[0].orderBy("rank").collect()]
    z, n, one = collections.defaultdict(float), collections.defaultdict(float), 1 << toxicity.BITS

    def weight(k):
        l1 = 0.0 if k == one else toxicity.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    own = {i: [*toxicity.features(t.encode()).tolist(), one] for i, t in rows}
    for _ in range(toxicity.EPOCHS):
        for i in order:
            w = {k: weight(k) for k in own[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - (i % 3 == 0)
            for k in own[i]:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if k != one and weight(k)}
    assert dict(zip(slots.tolist(), weights.tolist())) == pytest.approx(want) and intercept == pytest.approx(weight(one))


def test_views_teach_each_other():
    """co_train on two views: rounds as a naive loop over the same views."""
    rng = np.random.default_rng(9)
    truth = rng.integers(0, 2, 400)
    content = [np.array([10 + y * 5 + int(rng.integers(0, 3)), 50 + int(rng.integers(0, 9))], np.int32) for y in truth]
    meta = [np.array([100 + y * 5 + int(rng.integers(0, 3))], np.int32) for y in truth]
    labels = [int(y) if k < 60 else None for k, y in enumerate(truth)]
    views, mixed = quality.co_train(content, meta, labels)
    known, unknown = list(range(60)), list(range(60, 400))
    held, fitted, given, own = known[::4], [k for i, k in enumerate(known) if i % 4], [{}, {}], [quality.View(content), quality.View(meta)]
    for turn in range(quality.ROUNDS + 1):
        for v, taught in zip(own, given):
            rows = sorted([*fitted, *taught])
            v.fit(rows, [labels[i] if labels[i] is not None else taught[i] for i in rows], held, truth[held])
        if turn < quality.ROUNDS:
            for k in (0, 1):
                p = {i: float(quality.sigmoid(own[k].odds(own[k].features[i]))) for i in unknown if i not in given[1 - k]}
                for label, sure in ((1, lambda x: x), (0, lambda x: 1 - x)):
                    best = sorted((i for i in p if sure(p[i]) >= quality.CONFIDENT), key=lambda i: (-sure(p[i]), i))[: quality.MOST_NEW]
                    given[1 - k].update({i: label for i in best})
    odds = np.array([[v.odds(v.features[i]) for v in own] for i in held])
    assert given[0] and given[1] and mixed == pytest.approx(quality.logistic(odds, truth[held]))
    both = [mixed[0] * views[0].odds(c) + mixed[1] * views[1].odds(m) + mixed[2] for c, m in zip(content, meta)]
    assert np.mean((np.array(both) > 0) == (truth == 1)) > 0.95


def test_quality_of_texts_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels.where(~held_out(4, 2)))).join(labels, "doc_id").where(held_out(4, 2)).collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


# Lines


def test_removed_lines_are_those_of_brute_force(docs, texts):
    lines = [(i, n, line_dedup.words_of(x.encode())) for i, t in sorted(texts.items()) for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    want = collections.defaultdict(list)
    for k, (i, n, w) in enumerate(lines):
        for _, _, other in lines[:k]:
            if w == other or (min(len(w), len(other)) >= line_dedup.FUZZY and abs(len(w) - len(other)) < 2 and line_dedup.word_distance(w, other, 1) <= 1):
                want[i].append(n)
                break
    got = {r.doc_id: r.lines for r in line_dedup.removed_lines(docs).collect()}
    assert got == dict(want)


def test_word_edits(spark):
    base = "a b c d e f g h i j k l m".split()
    rows = [base, base[:4] + ["x"] + base[4:], base[1:], base[:6] + ["y"] + base[7:], base[:6] + ["y", "z"] + base[8:], base[::-1], base[:5]]
    docs = spark.createDataFrame([(k - 2, " ".join(w) + f"\nshort {k}") for k, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.lines for r in line_dedup.removed_lines(docs).collect()}
    assert got == {-1: [0], 0: [0], 1: [0], 2: [0]} or got == {-1: [0], 0: [0], 1: [0]} | ({2: [0]} if line_dedup.word_distance([x.encode() for x in rows[4]], [x.encode() for x in rows[3]], 1) <= 1 else {})


def test_only_repeats_are_lost_by_rows_that_share_an_id(spark):
    """Rows without an id, or with the same one, are documents of their own if their texts differ."""
    seen, only = "a line that all of these rows hold", "the only copy of sentence {} in all data"
    texts = [f"{only.format(k)}\n{seen}\nend {k}" for k in ("one", "two", "three", "four")] + [f"{seen}\n{only.format('five')}"]
    ids = [None, None, 7, 7, None]
    docs = spark.createDataFrame([*zip(ids, texts), (7, texts[3])], "doc_id long, text string")
    got = collections.Counter(r.text for r in line_dedup.dedup_lines(docs).collect())
    assert sum(t.count(seen) for t in got) == 1 and sum(got.values()) == 6
    assert all(sum(only.format(k) in t for t in got) == 1 for k in ("one", "two", "three", "four", "five"))
    assert sum(r.n_lines - len(r.removed_lines or ()) for r in line_dedup.dedup_lines(docs).collect()) == sum(t.count("\n") + 1 for t in got.elements())


def test_shortest_leaves_short_lines_alone(spark):
    docs = spark.createDataFrame([(1, "Menu\na b c"), (2, "menu\nA b  c\nx"), (3, "x")], "doc_id long, text string")
    got = lambda **k: {r.doc_id: r.lines for r in line_dedup.removed_lines(docs, **k).collect()}
    assert got() == {2: [0, 1], 3: [0]} and got(shortest=2) == {2: [1]} and got(shortest=4) == {}


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == 10
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.removed_lines is None for r in by[1]) and by[2][0].removed_lines == [0] and by[None][0].removed_lines == [0]
    assert by[3][0].text is None and by[6][0].text == "  \n\n "
    assert line_dedup.dedup_lines(none).count() == 0


# Near duplicates


def brute_classes(texts, docs):
    """Classes by all pairs; a shingle's df is the number of different texts that have it."""
    sets = {i: near_dups.shingles((t or "").encode()) for i, t in texts.items()}
    df, different = collections.Counter(), {}
    for i, t in texts.items():
        different.setdefault(t or "", i)
    for i in different.values():
        df.update(set(sets[i][0].tolist()))
    idf = lambda x: 1 + near_dups.DAMP * math.log((len(different) + 1) / (df[x] + 1)) / math.log(len(different) + 1)
    weight = {i: {x: k * idf(x) for x, k in zip(h.tolist(), c.tolist())} for i, (h, c, _) in sets.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            wa, wb = weight[a], weight[b]
            least = sum(min(wa[x], wb[x]) for x in wa.keys() & wb.keys())
            if least and least / (sum(wa.values()) + sum(wb.values()) - least) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_classes_are_those_of_brute_force(docs, texts):
    assert {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()} == brute_classes(texts, docs)


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CHUNK", 7)
    rng = np.random.default_rng(3)
    words, texts = [f"w{k}" for k in range(5000)], {}
    for group in range(3):
        base = rng.choice(words, 120).tolist()
        for k in range(40):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                w[at] = str(rng.choice(words))
            texts[group * 100 + k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()} == brute_classes(texts, docs)


def test_pairs_of_long_texts_come_in_bounded_batches(spark, monkeypatch, tmp_path):
    """A leader's set is sent with each of its pairs: 10,000 pairs of long texts in one batch are more than a worker has."""
    rng = np.random.default_rng(7)
    words, seen, real = [f"w{k}" for k in range(9000)], str(tmp_path / "batches"), type(spark.range(0)).mapInArrow

    def noted(self, function, schema):
        def run(batches):
            def each():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{batch.num_rows} {batch.nbytes}\n")
                    yield batch

            yield from function(each())

        return real(self, run, schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noted)
    base = rng.choice(words, 8000).tolist()
    rows = []
    for k in range(100):
        w = list(base)
        for at in rng.integers(0, len(w), 20):
            w[at] = str(rng.choice(words))
        rows.append((k, " ".join(w)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 100 and {(r.class_id, r.class_size, r.class_texts) for r in got} == {(0, 100, 100)}
    batches = [tuple(map(int, line.split())) for line in open(seen)]
    # One leader or more, each with 90 pairs or more of which either side has 12 bytes a shingle.
    assert sum(n for n, _ in batches) >= 90 and max(size for _, size in batches) <= (8 << 20) + 100_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_links_and_labels_are_few_files(spark, monkeypatch):
    """Each file that a task creates can start a process, which counts as much memory as its executor while it starts."""
    seen, real = collections.defaultdict(list), near_dups.written

    def noted(df, name):
        out = real(df, name)
        seen[name].append(len(out.inputFiles()))
        return out

    for module in (near_dups, components):
        monkeypatch.setattr(module, "written", noted)
    rng = np.random.default_rng(13)
    words, texts = [f"w{k}" for k in range(3000)], {}
    for group in range(8):
        base = rng.choice(words, 150).tolist()
        for _ in range(10):
            w = list(base)
            for at in rng.integers(0, 150, rng.integers(2, 5)):
                w[at] = str(rng.choice(words))
            texts[len(texts)] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_classes(texts, docs)
    thin = {"partners", "labels", "pairs", "ends", "leaders", "verified", "links", "label-edges", "open", "block-links"}
    assert thin <= seen.keys() and all(n <= 3 for name in thin for n in seen[name])


def test_blocks_of_long_texts_are_bounded(spark, monkeypatch, tmp_path):
    """Thirty texts of one group that were one chunk: all pairs are compared, in blocks of bounded bytes."""
    monkeypatch.setattr(near_dups, "CHUNK_BYTES", 60_000, raising=False)
    rng = np.random.default_rng(8)
    seen, links, sets = str(tmp_path / "blocks"), near_dups.block_links, {}
    for k in range(30):
        own = rng.choice(1 << 40, 1000, replace=False)
        if k >= 15:  # a copy of the text before it but for a few shingles
            own = np.concatenate([np.frombuffer(sets[k - 15][0], np.uint64).astype(np.int64)[40:], own[:40]])
        sets[k] = np.unique(own).astype(np.uint64).tobytes(), np.ones(len(np.unique(own)), np.float32).tobytes()

    def noted(own, *rest):
        with open(seen, "a") as f:
            f.write(f"{sum(12 * len(h) for h, _ in own)}\n")
        return links(own, *rest)

    monkeypatch.setattr(near_dups, "block_links", noted)
    names = {k: bytes([k]) * 16 for k in sets}
    texts = spark.createDataFrame([(names[k], h, w, len(h) + len(w)) for k, (h, w) in sets.items()], "digest binary, hashes binary, weights binary, size long")
    members = spark.createDataFrame([(1, names[k], names[k]) for k in sets], "key long, digest binary, label binary")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in near_dups.blocks_compared(members, texts).collect()}
    assert got == {frozenset((names[k], names[k + 15])) for k in range(15)}
    assert max(int(x) for x in open(seen)) < 30 * 12_000 * 0.8


def test_classes_do_not_depend_on_partitions_or_files(spark):
    """Edits near the threshold: df, and with it every link, is the table's alone."""
    rng = np.random.default_rng(11)
    words, rows = [f"w{k}" for k in range(3000)], []
    for group in range(12):
        base = rng.choice(words, 200).tolist()
        for _ in range(12):
            w = list(base)
            for at in rng.integers(0, 200, rng.integers(3, 6)):
                w[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(dict(rows), docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, files in ((2, 1), (24, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.doc_id: r.class_id for r in near_dups.classes(docs.repartition(files, "doc_id")).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_compare_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        h = np.sort(rng.choice(60, rng.integers(20, 50), replace=False)).astype(np.uint64)
        sets.append((h, (rng.integers(1, 3, len(h)) * (1 + h.astype(float) / 100)).astype(np.float32).astype(float)))
    monkey = near_dups.SIMILAR
    near_dups.SIMILAR = 0.55
    try:
        found = near_dups.block_links(sets, list(range(30)), list(range(30)), list(range(30)))
    finally:
        near_dups.SIMILAR = monkey
    parent = list(range(30))

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = list(range(30))
    for x, y in found:
        parent[root(parent, x)] = root(parent, y)
    for x in range(30):
        for y in range(x):
            if near_dups.similarity(*[(s[0].tobytes(), s[1].astype(np.float32).tobytes()) for s in (sets[x], sets[y])]) >= 0.55 - 1e-6:
                other[root(other, x)] = root(other, y)
    assert len({(root(parent, k), root(other, k)) for k in range(30)}) == len({root(other, k) for k in range(30)}) == len({root(parent, k) for k in range(30)})


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    h = np.arange(400, dtype=np.uint64) * near_dups._P
    wa, wb = rng.uniform(0.5, 2, 400), rng.uniform(0.5, 2, 400)
    sampler = near_dups.Sampler(2000)
    like = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sampler(h, wa) == sampler(h, wb)).mean() - like) < 0.04


def test_near_dups_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in near_dups.classes(odd).collect()}
    assert got[2].class_id == 1 and got[4].class_id == got[6].class_id == 3 and got[5].class_id == 5
    kept = near_dups.without_near_dups(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    assert near_dups.classes(none).count() == 0 and near_dups.without_near_dups(none).count() == 0


def test_rows_that_share_an_id_are_not_taken_for_each_other(spark):
    base, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "b"))
    rows = [(1, base), (None, base), (None, base), (None, other), (None, "third"), (5, "fourth " + other), (5, base), (6, base.upper() + " a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dups.without_near_dups(docs).collect()
    assert sorted(r.text for r in kept) == sorted([base, "fourth " + other, "third"])
    assert {r.class_id for r in near_dups.classes(docs).collect()} == {1, 5, None}


def test_planted_near_copies_are_found(spark):
    """Copies with as many words edited as leaves 0.85 of the weight alike, among texts of one vocabulary."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    texts, planted = {}, {}
    for k in range(150):
        w = rng.choice(words, int(rng.integers(150, 400))).tolist()
        texts[k], texts[1000 + k] = " ".join(w), " ".join(w)
        edited = list(w)
        for at in rng.integers(0, len(w), max(1, len(w) // 150)):
            edited[int(at)] = str(rng.choice(words))
        texts[2000 + k], planted[2000 + k] = " ".join(edited).capitalize(), k
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert all(got[1000 + k] == k for k in range(150)) and np.mean([got[i] == k for i, k in planted.items()]) >= 0.9
    assert len(set(got.values())) <= 150 + 15


def test_packing():
    for v in ([], [5], [1, 2, 1 << 20], [0, 1 << 40, (1 << 48) - 1]):
        a = np.array(v, np.uint64)
        assert near_dups.unpacked(near_dups.packed(a)).tolist() == v
    assert len(hash_words(b" A b\x0bc ")) == 3 and (hash_words(b"A") == hash_words(b"a")).all()


# Mixing


def test_mix_meets_targets(docs, texts):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in got) and len(got) == len(texts)
    totals, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        totals[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(totals))}
    fixed: dict = {}
    while True:
        rest, open_ = sum(totals.values()) - sum(fixed.values()), [s for s in totals if s not in fixed]
        level = rest / sum(weight[s] for s in open_)
        new = {s: 3 * totals[s] for s in open_ if level * weight[s] > 3 * totals[s]}
        if not new:
            break
        fixed |= new
    for s in totals:
        assert target[s] == pytest.approx(fixed.get(s, level * weight[s])) and abs(taken[s] - target[s]) <= 1
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert all(list(r.positions) == sorted(r.positions) and -(-r.taken // max(1, r["size"])) == len(r.positions) for r in got)
    # Up to any time the copies that are due hold that share of all tokens, and a target of several sizes is spread over all of it.
    copies = sorted((x, min(r["size"], r.taken - k * r["size"])) for r in got for k, x in enumerate(r.positions))
    whole, largest = sum(n for _, n in copies), max(r["size"] for r in got)
    for t in (0.2, 0.5, 0.8):
        assert sum(n for x, n in copies if x <= t) / whole == pytest.approx(t, abs=len(totals) * largest / whole + 0.02)
    assert copies[-1][0] > 0.8
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_schedule_is_inverted(spark):
    got = spark.range(0, 101).select((F.col("id") / 100).alias("u"), mixing.due(F.col("id") / 100, F.lit(0.5)).alias("t"), mixing.due(F.col("id") / 100, F.lit(-0.5)).alias("v")).collect()
    assert all(r.t + 0.5 * r.t * (1 - r.t) == pytest.approx(r.u) and r.v - 0.5 * r.v * (1 - r.v) == pytest.approx(r.u) for r in got)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r["size"] == 0) and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_each_row_is_mixed_by_its_own_size(spark):
    rows = [(None, "one", "a"), (None, "one two three", "a"), (None, "one", None), (7, "a b", "b"), (7, "a b c d", "b"), (7, "a b", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs).collect()
    assert all(r["size"] == len(r.text.split()) and 0 < r.taken <= 3 * r["size"] for r in got)
    plan = collections.Counter((r.doc_id, r["size"], r.source) for r in mixing.mix(docs).collect())
    assert plan == collections.Counter((i, len(t.split()), s) for i, t, s in rows)
    repeats = [r.taken for r in mixing.mix(docs).collect() if r.doc_id == 7 and r["size"] == 2]
    assert len(repeats) == 2 and max(repeats) - min(repeats) <= 1


def test_a_target_is_met_inside_repeated_rows(spark):
    """A thousand rows that are all alike, half of which the mix takes, to the word; with texts as well."""
    rows = [(1, "x", "a")] * 1000 + [(2, "y " * 500, "b")] + [(3, "z z z", "c")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for got in (mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()):
        for source in "abc":
            own = [r for r in got if r.source == source]
            assert sum(r.taken for r in own) == round(own[0].target) and max(r.taken for r in own) - min(r.taken for r in own) <= 1


# Decontamination


def test_matches_are_those_of_brute_force(spark, docs, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    patterns = [(i, decontamination.Pattern(n), int(0.1 * (len(n) - 2))) for i, n in ((i, decontamination.normalised(t)) for i, t in items)]
    plain = {i: decontamination.normalised(t) for i, t in texts.items()}
    for i, t in plain.items():
        for item, pattern, budget in patterns:
            distance, _ = pattern.search(t)
            if distance <= budget:
                want[i, item] = distance
    found = decontamination.find_matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == want and want
    own = {i: decontamination.normalised(t) for i, t in items}
    assert all(edits(plain[r.doc_id][r.start : r.end], own[r.item_id]) == r.distance for r in found)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def test_short_items_match_whole_words_only(spark):
    docs = spark.createDataFrame([(1, "other weather"), (2, "The end"), (3, "a b"), (4, "ab"), (None, "the, other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "A")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_matches(docs, items).collect()} == {(2, 1), (None, 1), (3, 2)}
    assert [r.doc_id for r in decontamination.decontaminated(docs, items).collect()] == [1, 4]


def test_large_texts_and_items_lose_no_match():
    """A very long text with passages at its ends and in the middle, edited up to the budget."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 6)))
    items = [(k, " ".join(word() for _ in range(60))) for k in range(5)]
    cut = lambda t, n: "".join(c for i, c in enumerate(t) if i not in set(rng.choice(np.arange(1, len(t) - 1), n, replace=False).tolist()))
    filler = " ".join(word() for _ in range(30_000))
    text = " ".join([cut(items[0][1], 5), filler, items[1][1], cut(items[2][1], int(0.1 * len(items[2][1]))), filler, items[3][1]])
    plain = decontamination.normalised(text)
    want = {k: d for k, t in items for d, b in [(decontamination.Pattern(decontamination.normalised(t)).search(plain)[0], int(0.1 * (len(decontamination.normalised(t)) - 2)))] if d <= b}
    got = decontamination.Matcher(items).matches(text)
    assert {k: d for k, d, _, _ in got} == want and {0, 1, 3} <= set(want)
    assert all(edits(plain[a:b], decontamination.normalised(items[k][1])) == d for k, d, a, b in got)


def test_edited_passages_are_found():
    rng = np.random.default_rng(4)
    item = "".join(rng.choice(list("abcdefghij "), 200))
    matcher, n = decontamination.Matcher([(1, item)]), len(decontamination.normalised(item)) - 2
    for _ in range(40):
        chars = list(item)
        for _ in range(int(0.1 * n) - 3):
            at = int(rng.integers(0, len(chars)))
            if rng.random() < 0.5:
                chars[at] = "z"
            elif rng.random() < 0.5:
                del chars[at]
            else:
                chars.insert(at, "q")
        text = "some text before " + "".join(chars) + " and after"
        best, _ = decontamination.Pattern(decontamination.normalised(item)).search(decontamination.normalised(text))
        assert bool(matcher.matches(text)) == (best <= int(0.1 * n))


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "five six SEVEN eight"), (2, None), (3, ""), (4, "five six seven eight")], "item_id long, text string")
    got = decontamination.find_matches(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in (1, 2, None) for k in (1, 4)} and len(got) == 8
    clean = decontamination.decontaminated(odd, items)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 7, 8]
    assert decontamination.decontaminated(odd, items.limit(0)).count() == 10 and decontamination.find_matches(none, items).count() == 0


def test_a_fit_holds_a_bounded_number_of_features():
    rows = [(0.1, 1, [1, 2]), (0.2, 0, []), (0.3, None, [3, 4, 5]), (0.4, 1, [6])]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2]), (pa.float64(), pa.int32(), pa.list_(pa.int32())))], ["rank", "label", "slots"]) for a in (0, 2)]
    taken = lambda most: [r[0] for r in sampling.first_rows(iter(batches), ("slots",), most)]
    assert [taken(most) for most in (1, 2, 4, 5, 6)] == [[], [0.1, 0.2], [0.1, 0.2], [0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.4]]
    assert [r[2].tolist() for r in sampling.first_rows(iter(batches), ("slots",), 9)] == [r[2] for r in rows]
