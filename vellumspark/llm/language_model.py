"""Language-model scoring with a weighted backoff automaton (operator 5).

Tokens are the words of a text (A-Z lowered, split at ASCII white space) and one end. The model has every word, pair and
triple of all training documents, at any size of the corpus: none is cut by its frequency.

Smoothing is hierarchical Dirichlet: p(w | h) = (c(hw) + M p(w | h')) / (c(h) + M), where h' is h without its first word
and M = PRIOR[1] or PRIOR[2] by the length of h; words start from p(w) = (c(w) + ADD) / (N + ADD (V + 1)). It sums to 1
over all words for any h and needs nothing but counts. States are the contexts seen; an arc holds p(w | h) of an n-gram
seen; a failure arc holds M / (c(h) + M) and leads to the state of h'. A text is read once from left to right: its state
takes the arc of the next token, or fails until there is one (the root has one for each word), and log-probabilities
add up.

The automaton of a corpus doesn't fit into a task, so each block of texts is read with that part of it that the block can
reach, which is exact:
1. Documents are dealt into blocks of about BLOCK_BYTES by row, so that no key makes a block large.
2. A block sends its distinct words, pairs and triples, hashed, with their training counts to the owners of their hash
   ranges. An n-gram of any frequency is one entry of a block, so a hot one is no hot group.
3. Owners add up and answer with the totals in the order asked, so only counts travel back.
Words are known by all 64 bits of their hash: among a billion distinct ones, two meet by chance in one table of forty.
Pairs and triples have keys of 36 bits within a range, and the ranges grow in number with the corpus: one
of them meets another by chance with a probability of about one in 10**5, whatever the size. Counts have up to 64 bits.

Defined results: a null or empty text is its end alone; a null doc_id is a training document; repeated rows each get
their row, and count as often as they stand; without training documents all words are unknown; an empty table gives an
empty result; other columns are ignored. docs should be a table (or a checkpoint), as its rows are dealt by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import batches_of, hash_words, row_blocks, shuffle_partitions, small_batches, texts_of

#: The weight of the shorter context, in tokens, for contexts of one and of two words.
PRIOR = {1: 300.0, 2: 10.0}
ADD = 0.1
BLOCK_BYTES, BATCH = 4 << 20, 1_000
#: Distinct words that a task holds before it sends what it has.
HELD = 1_000_000
#: Symbols of a text that are read in one go.
SEGMENT = 512
ASKED = "block int, part int, words binary, keys binary, counts binary"
TOTALS = "block int, part int, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_END = np.uint64(0xD6E8FEB86659FD93)
_LOCAL = np.uint64(36)
_MASK = np.uint64((1 << 36) - 1)
_FOUR = 0xFFFFFFFF


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def found_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in `known`, ascending, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


# What travels


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then the steps between them as planes of bytes, of which the upper ones are nearly all 0
    and shrink when they are sent. Nothing for no keys."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    planes = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return bytes([planes]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, -1, 9).reshape(data[0], -1) if data[0] else np.zeros((1, 0), np.uint8)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : len(planes)] = planes.T
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), steps.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each; 255 stands for the next of the larger ones, of four bytes, and the largest of those for the next of eight."""
    large = counts[counts >= 255]
    huge = large[large >= _FOUR]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.minimum(large, _FOUR).astype(np.uint32).tobytes() + huge.astype(np.int64).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    more = np.flatnonzero(out == 255)
    large = np.frombuffer(data[n : n + 4 * len(more)], np.uint32).astype(np.int64)
    large[large == _FOUR] = np.frombuffer(data[n + 4 * len(more) :], np.int64)
    out[more] = large
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each, ascending with the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def by_part(*parts: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """Each part in ascending arrays of parts, with where it is in each of them."""
    present = np.unique(np.concatenate(parts))
    cuts = [(np.searchsorted(p, present, "left").tolist(), np.searchsorted(p, present, "right").tolist()) for p in parts]
    return ((part, [slice(a[k], b[k]) for a, b in cuts]) for k, part in enumerate(present.tolist()))


# Blocks of texts


class Tokens:
    """Texts as numbers of symbols (the last is the end, which also stands before each text), with their distinct n-grams."""

    def __init__(self, texts: list[bytes]):
        words = [hash_words(t) for t in texts]
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.names, at = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
        self.end = len(self.names)
        self.size = self.end + 1
        self.ids = np.full(int(self.lengths.sum()), self.end, np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[self.starts + self.lengths - 1] = False
        self.ids[inner] = at
        self.pairs, self.pair_at = np.unique(np.concatenate([[self.end], self.ids[:-1]]) * self.size + self.ids, return_inverse=True)
        #: Where a triple ends: a text's first token has the start alone before it.
        third = np.ones(len(self.ids), bool)
        third[self.starts] = False
        self.third = np.flatnonzero(third)
        self.triples, self.triple_at = np.unique(self.pair_at[self.third - 1] * self.size + self.ids[self.third], return_inverse=True)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words with the end, and of pairs and triples."""
        one = np.append(mixed(self.names + _R), _END)
        a, b = np.divmod(self.pairs, self.size)
        two = mixed(one[a] * _Q + mixed(one[b]))
        ab, c = np.divmod(self.triples, self.size)
        return one, np.concatenate([two, mixed(two[ab] * _P + mixed(one[c] * _R))])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often the words, the end, pairs and triples stand in training texts."""
        every = np.repeat(train, self.lengths)
        return np.concatenate([
            np.bincount(self.ids[every], minlength=self.size),
            np.bincount(self.pair_at[every], minlength=len(self.pairs)),
            np.bincount(self.triple_at[every[self.third]], minlength=len(self.triples)),
        ])

    def split(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return counts[: self.size], counts[self.size : self.size + len(self.pairs)], counts[self.size + len(self.pairs) :]


class Sent:
    """What a block of texts asks for: ascending keys of its words and of its longer n-grams, by hash range."""

    def __init__(self, tokens: Tokens, parts: int):
        one, longer = tokens.keys()
        self.words, self.word_at = np.unique(one, return_inverse=True)
        self.grams, self.gram_at = np.unique(part_of(longer, parts) << _LOCAL | longer & _MASK, return_inverse=True)
        self.pieces = list(by_part(part_of(self.words, parts), self.grams >> _LOCAL))

    def asking(self, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """part, words, keys and counts of each piece, from the counts of all n-grams."""
        ends = len(self.word_at)
        words = np.bincount(self.word_at, counts[:ends], len(self.words)).astype(np.int64)
        grams = np.bincount(self.gram_at, counts[ends:], len(self.grams)).astype(np.int64)
        for part, (w, g) in self.pieces:
            yield part, packed_keys(self.words[w]), packed_keys(self.grams[g] & _MASK), packed_counts(np.concatenate([words[w], grams[g]]))

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """The totals of all n-grams, from those of each piece."""
        words, grams = np.zeros(len(self.words), np.int64), np.zeros(len(self.grams), np.int64)
        for part, (w, g) in self.pieces:
            n = w.stop - w.start
            totals = unpacked_counts(answers[part], n + g.stop - g.start)
            words[w], grams[g] = totals[:n], totals[n:]
        return np.concatenate([words[self.word_at], grams[self.gram_at]])


class Automaton:
    """States 0: root, 1 + s: after symbol s, then one for each pair seen in training.

    one: p of each symbol; counts: of symbols; pairs (a * n + b) and triples (number of the pair * n + c) with theirs.
    """

    def __init__(self, one: np.ndarray, counts: np.ndarray, pairs: np.ndarray, c2: np.ndarray, triples: np.ndarray, c3: np.ndarray):
        n, (m1, m2) = len(one), (PRIOR[1], PRIOR[2])
        a, b = np.divmod(pairs, n)
        seen2, seen3 = c2 > 0, c3 > 0
        two = (c2 + m1 * one[b]) / (counts[a] + m1)
        state2 = np.where(seen2, n + np.cumsum(seen2), 1 + b)
        ab, c = np.divmod(triples[seen3], n)
        bc = np.searchsorted(pairs, b[ab] * n + c)  # a triple that was seen has pairs that were
        three = (c3[seen3] + m2 * two[bc]) / (c2[ab] + m2)
        keys = np.concatenate([(1 + a[seen2]) * n + b[seen2], state2[ab] * n + c])
        order = np.argsort(keys, kind="stable")
        self.symbols, self.root, self.arcs = n, np.log10(one), keys[order]
        self.log = np.log10(np.concatenate([two[seen2], three]))[order]
        self.to = np.concatenate([state2[seen2], state2[bc]])[order]
        # A context that was never seen passes on to the shorter one whole.
        self.left = np.log10(np.concatenate([[1.0], m1 / (counts + m1), m2 / (c2[seen2] + m2)]))
        self.fail = np.concatenate([np.zeros(1 + n, np.int64), 1 + b[seen2]])

    def read(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, symbols ids[start : start + length]: all texts step together, left to right.

        A long text is read in segments side by side: the state before a segment is that of its two symbols before it,
        which is all that a state remembers.
        """
        n, pieces = self.symbols, -(-lengths // SEGMENT)
        of = np.repeat(np.arange(len(lengths)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, size = starts[of] + k * SEGMENT, np.minimum(lengths[of] - k * SEGMENT, SEGMENT)
        state = np.full(len(of), n)  # after the end, which stands before the text
        later = np.flatnonzero(k)
        last = ids[begin[later] - 1]
        at, hit = found_in(self.arcs, (1 + ids[begin[later] - 2]) * n + last)
        state[later] = np.where(hit, self.to[at] if len(self.to) else 0, 1 + last)
        order = np.argsort(-size, kind="stable")
        begin, size, state, total = begin[order], size[order], state[order], np.zeros(len(order))
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for step, count in enumerate(active):
            w = ids[begin[:count] + step]
            now, sums = state[:count], total[:count]
            there = np.arange(count)
            while len(there):
                s = now[there]
                top = s == 0
                if top.any():
                    done = there[top]
                    sums[done] += self.root[w[done]]
                    now[done] = 1 + w[done]
                    there, s = there[~top], s[~top]
                at, hit = found_in(self.arcs, s * n + w[there])
                sums[there[hit]] += self.log[at[hit]]
                now[there[hit]] = self.to[at[hit]]
                there, s = there[~hit], s[~hit]
                sums[there] += self.left[s]
                now[there] = self.fail[s]
        # Segments add up in their order, so that reruns give the same sums.
        back = np.empty(len(order))
        back[order] = total
        return np.bincount(of, weights=back, minlength=len(lengths))


# Jobs


def word_totals(training: DataFrame, parts: int) -> tuple[int, int]:
    """Words and distinct words of the texts: hash ranges of words meet, each of which counts its own."""

    def pieces(keys: np.ndarray, tokens: int) -> Iterator[pa.RecordBatch]:
        rows = [(part, packed_keys(keys[at]), 0 if at.start else tokens) for part, (at,) in by_part(part_of(keys, parts))]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["part", "keys", "tokens"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word once for a task, or for HELD of its words."""
        known, tokens = np.zeros(0, np.uint64), 0
        for batch in small_batches(batches, "text", BLOCK_BYTES):
            words = [hash_words(t) for t in texts_of(batch.column("text"))]
            tokens += sum(map(len, words))
            known = np.unique(np.concatenate([known, *words]))
            if len(known) > HELD:
                yield from pieces(known, tokens)
                known, tokens = known[:0], 0
        yield from pieces(known, tokens)

    def count(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked_keys(x) for x in group.column("keys").to_pylist()])
        return pa.table([pa.array([len(np.unique(keys))], pa.int64()), pa.array([sum(group.column("tokens").to_pylist())], pa.int64())], ["types", "tokens"])

    with batches_of(training.sparkSession, BATCH):
        found = training.select("text").mapInArrow(send, "part int, keys binary, tokens long").groupBy("part").applyInArrow(count, "types long, tokens long").agg(F.sum("tokens"), F.sum("types")).first()
    return found[0] or 0, found[1] or 0


def _texts(block: pa.Table) -> list[bytes]:
    return list(texts_of(block.column("text").combine_chunks()))


def asked(dealt: DataFrame, parts: int) -> DataFrame:
    """The n-grams of each block by hash range, with their counts in its training texts."""

    def send(block: pa.Table) -> pa.Table:
        tokens = Tokens(_texts(block))
        number = block.column("block")[0].as_py()
        rows = [(number, *piece) for piece in Sent(tokens, parts).asking(tokens.counts(~block.column("held").to_numpy()))]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "part", "words", "keys", "counts"])

    return dealt.groupBy("block").applyInArrow(send, ASKED)


def answered(pieces: DataFrame) -> DataFrame:
    """The same pieces, each with the totals of its keys over all blocks."""

    def add_up(group: pa.Table) -> pa.Table:
        asked_for = [[unpacked_keys(x) for x in group.column(c).to_pylist()] for c in ("words", "keys")]
        sizes = [(len(w), len(g)) for w, g in zip(*asked_for, strict=True)]
        counts = [unpacked_counts(x, w + g) for x, (w, g) in zip(group.column("counts").to_pylist(), sizes, strict=True)]
        totals = []
        for keys, own in zip(asked_for, ([c[:w] for c, (w, _) in zip(counts, sizes, strict=True)], [c[w:] for c, (w, _) in zip(counts, sizes, strict=True)]), strict=True):
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(own)).astype(np.int64)[at]
            totals.append(np.split(sums, np.cumsum([len(k) for k in keys])[:-1]))
        out = [packed_counts(np.concatenate(both)) for both in zip(*totals, strict=True)]
        return pa.table([group.column("block"), group.column("part"), pa.array(out, pa.binary())], ["block", "part", "counts"])

    return pieces.groupBy("part").applyInArrow(add_up, TOTALS)


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count_if(~F.col("held"))).first()
    ends, blocks = size[1], max(1, shuffle_partitions(spark), -(-(size[0] or 0) // BLOCK_BYTES))
    words, word_types = word_totals(rows.where(~F.col("held")), blocks)
    tokens, types = words + ends, word_types + (ends > 0)
    dealt = row_blocks(rows, blocks)

    def read(key, block: pa.Table, totals: pa.Table) -> pa.Table:
        texts = Tokens(_texts(block)) if block.num_rows else None
        if texts is None:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        answers = dict(zip(totals.column("part").to_pylist(), totals.column("counts").to_pylist(), strict=True))
        c1, c2, c3 = texts.split(Sent(texts, blocks).told(answers))
        one = (c1 + ADD) / (tokens + ADD * (types + 1))
        base = np.add.reduceat(np.log10(one)[texts.ids], texts.starts)
        known = np.add.reduceat((c1 > 0).astype(np.int64)[texts.ids], texts.starts)
        found = Automaton(one, c1, texts.pairs, c2, texts.triples, c3).read(texts.ids, texts.starts, texts.lengths)
        return pa.table([block.column("doc_id"), block.column("held"), pa.array(texts.lengths), pa.array(known), pa.array([tokens] * block.num_rows, pa.int64()), pa.array(base), pa.array(found)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    totals = answered(asked(dealt, blocks))
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(read, SCORES)
