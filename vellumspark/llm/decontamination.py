"""Benchmark decontamination by pigeonhole edit matching (operator 10).

Texts are compared lower-cased, with each run of characters other than letters and digits as one space, and one space at
either end, of texts and of items. An item of n characters without these has an error budget of k = floor(rate * n) edits
and is split into k + 1 pieces: a text within k edits of it holds at least one piece exactly. All pieces of all items are
looked up in one Aho-Corasick pass; a hit is verified up a binary tree over the pieces, in which a node of j pieces has a
budget of j - 1 edits (if a node is matched within its budget, so is a child within its own), with Myers' bit-parallel
distance; the root is the whole item with budget k. So no match within the budget is lost, and chance hits end at a
short pattern. The spaces at the ends make an item match at word boundaries; an item too short for an edit matches only
as whole words. An item of one common word marks each text that has the word: that is what the benchmark asks for.

Defined results: a null or empty text matches nothing, a null or empty item (after normalising) is never matched; equal
items each match; repeated rows each give their matches; an empty table on either side gives an empty result; other
columns are ignored, and filtering keeps the columns of the input as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import small_batches, texts_of

ERROR_RATE = 0.1
MATCH_SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
#: Items are broadcast in blocks of about this many bytes of text, which take about 60 times as much as an automaton; a
#: larger benchmark takes more passes over the documents.
BLOCK_BYTES = 2 << 20
#: The matcher of the block that this worker has read last.
_matcher: dict[str, Matcher] = {}
_NOT_WORD = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Words with one space around each, or nothing."""
    words = _NOT_WORD.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def budget_of(item: str, rate: float) -> int:
    """Edits that a normalised item may take; its outer spaces don't count."""
    return int(rate * (len(item) - 2))


class Pattern:
    """Myers' bit-vector search for the best end of a match of a pattern inside a text."""

    def __init__(self, text: str):
        self.size = len(text)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(text):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def search(self, text: str, stop: int = 0, anchored: bool = False) -> tuple[int, int]:
        """The least distance of the pattern to any part of the text (anchored: that starts with the text), and where the
        first such part ends; looks no further once the distance is `stop`."""
        mask, high, peq = (1 << self.size) - 1, 1 << (self.size - 1), self.peq
        pv, mv, score, best, end = mask, 0, self.size, self.size, 0
        for i, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best, end = score, i + 1
                    if best <= stop:
                        break
            ph = (ph << 1 | anchored) & mask
            pv = ((mh << 1) & mask) | (mask & ~(xv | ph))
            mv = ph & xv
        return best, end


class Node:
    """Pieces [first, last) of an item, with what is above them."""

    __slots__ = ("above", "budget", "end", "pattern", "start", "text")

    def __init__(self, text: str, start: int, end: int, budget: int, above: Node | None):
        self.start, self.end, self.budget, self.above = start, end, budget, above
        self.text, self.pattern = text[start:end], None

    def found(self, text: str, low: int, high: int) -> tuple[int, int]:
        if self.pattern is None:
            self.pattern = Pattern(self.text)
        return self.pattern.search(text[low:high])


class Matcher:
    """All items of a block as one automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        pieces: dict[str, list[tuple[int, Node]]] = defaultdict(list)
        self.roots: list[tuple[int, Node]] = []
        for item_id, raw in items:
            text = normalised(raw or "")
            if not text:
                continue
            budget = budget_of(text, rate)
            root = Node(text, 0, len(text), budget, None)
            at = len(self.roots)
            self.roots.append((item_id, root))
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            stack = [(root, 0, budget + 1)]
            while stack:
                node, first, last = stack.pop()
                if last - first == 1:
                    pieces[node.text].append((at, node))
                    continue
                middle = (first + last) // 2
                for a, b in ((first, middle), (middle, last)):
                    stack.append((Node(text, cuts[a], cuts[b], b - a - 1, node), a, b))
        self.automaton = ahocorasick.Automaton()
        for text, nodes in pieces.items():
            self.automaton.add_word(text, (len(text), nodes))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item within its budget; offsets in the normalised text.

        A match ends where it first is that near, and starts as late as it can for that end."""
        if not self.roots or not raw:
            return []
        text = normalised(raw)
        if not text:
            return []
        passed: dict[tuple[int, int], int] = {}  # (node, diagonal) that was tried: its result is not needed again
        best: dict[int, tuple[int, int]] = {}
        for last, (size, nodes) in self.automaton.iter(text):
            for at, leaf in nodes:
                if best.get(at, (1,))[0] == 0:
                    continue
                # Where the item begins if there are no edits before the hit.
                origin = last + 1 - size - leaf.start
                node, distance, end = leaf.above, 0, last + 1
                if node is None:
                    best[at] = (0, last + 1)
                    continue
                while node is not None:
                    key = (id(node), origin)
                    if key in passed:
                        break
                    passed[key] = 1
                    low = max(0, origin + node.start - node.budget)
                    distance, end = node.found(text, low, max(0, origin + node.end + node.budget))
                    if distance > node.budget:
                        break
                    end, node = low + end, node.above
                else:
                    if at not in best or distance < best[at][0]:
                        best[at] = (distance, end)
        return [(self.roots[at][0], distance, self.begin(at, text, distance, end), end) for at, (distance, end) in sorted(best.items())]

    def begin(self, at: int, text: str, distance: int, end: int) -> int:
        """Where the part of the text that ends there and is so near to the item begins: a search from the end backwards."""
        item = self.roots[at][1].text
        if not distance:
            return end - len(item)
        _, size = Pattern(item[::-1]).search(text[max(0, end - len(item) - distance) : end][::-1], distance, True)
        return end - size


def matcher_of(key: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """Built once for a worker and block of items; only the last is held."""
    if key not in _matcher:
        _matcher.clear()
        _matcher[key] = Matcher(items, rate)
    return _matcher[key]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver: a stated query set against all documents."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end of each document and item that it holds within the budget."""
    spark = docs.sparkSession
    out = None
    for items in item_blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value, rate)
            for batch in small_batches(batches, "text"):
                rows = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True) for m in matcher.matches(text.decode())]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, with their columns, that hold no item; documents pass through and are not shuffled."""
    spark, kept = docs.sparkSession, docs
    for items in item_blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value, rate)
            for batch in small_batches(batches, "text"):
                clean = [not matcher.matches(text.decode()) for text in texts_of(batch.column("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
