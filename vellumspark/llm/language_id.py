"""Language identification by compression (operator 4).

For each language a zstandard raw-content dictionary is made of a bounded sample of its training texts. A text is
reduced to lower-case letters and single spaces, cut into chunks of CHUNK bytes so that every part of a long text has to
draw on the dictionary, and compressed with each dictionary; the language with the smallest total is chosen, ties going
to the language with more training texts, then in code-point order. A prediction is accepted only if the runner-up is
larger by MARGIN of its size.

Bounds of the sample that is learned from: the LANGUAGES languages with most training texts, TEXTS texts of each chosen by
a hash of their id, of which the middle PIECE characters are taken, and DICTIONARY_BYTES of dictionary for each language.

Defined results: `und` with score 0 and accepted false where the text is null or has no letter, or nothing was learned;
whole texts are read however long; repeated rows each get their row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import arrow_map, texts_of
from vellumspark.llm.sampling import hash_unit

#: Bounds of the sample; what is broadcast is LANGUAGES * DICTIONARY_BYTES at most.
LANGUAGES, TEXTS, DICTIONARY_BYTES = 200, 120, 192 << 10
PIECE = DICTIONARY_BYTES // 64
CHUNK, LEVEL, MARGIN = 4096, 5, 0.005
_NOT_LETTER = re.compile(r"[\W\d_]+")


def cleaned(text: str) -> bytes:
    out = _NOT_LETTER.sub(" ", text.lower()).strip()
    return out.encode() if any(c.isalpha() for c in out) else b""


def dictionaries(docs: DataFrame, training: Column, texts: int = TEXTS) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null lang, from `texts` of its training texts at most."""
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES)
    counts = {r[0]: r[1] for r in most.collect()}
    if not counts:
        return {}
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, (1.2 * texts + 20) / n))]), F.col("lang"))
    # What is sorted and sent to the driver is bounded by the number of languages, not of documents; rows without an id,
    # or that share one, are told apart by their text.
    chosen = known.select("lang", "doc_id", "text", hash_unit("doc_id", "text").alias("rank")).where(F.col("rank") < share)
    part = F.substring("text", F.greatest(F.lit(1), (F.length("text") - PIECE) / 2).cast("int"), F.lit(PIECE))
    rows = chosen.select("lang", "rank", part.alias("text")).distinct().orderBy("lang", "rank", "text").toLocalIterator()
    gathered: dict[str, list[bytes]] = {}
    for lang, _, text in rows:
        got = gathered.setdefault(lang, [])
        if len(got) < texts and (clean := cleaned(text)):
            got.append(clean)
    # The end of a dictionary is nearest to the text, and its size is bounded.
    order = sorted((lang for lang, got in gathered.items() if got), key=lambda lang: (-counts[lang], lang))
    return {lang: b" ".join(gathered[lang])[-DICTIONARY_BYTES:] for lang in order}


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.languages = list(raw)
        self.compressors = []
        for data in raw.values():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # Matches of three bytes count too: short texts share little more with their language.
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), source_size=CHUNK, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            own.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))

    def sizes(self, clean: bytes) -> list[int]:
        chunks = [clean[i : i + CHUNK] for i in range(0, len(clean), CHUNK)]
        return [sum(len(c.compress(chunk)) for chunk in chunks) for c in self.compressors]

    def __call__(self, text: str) -> tuple[str, float, bool, float]:
        """(language, score, accepted, margin)."""
        clean = cleaned(text)
        if not clean or not self.languages:
            return "und", 0.0, False, 0.0
        sizes = self.sizes(clean)
        best = min(sizes)
        at = sizes.index(best)
        second = min((s for i, s in enumerate(sizes) if i != at), default=best * 2)
        margin = (second - best) / second if second else 0.0
        # Bytes saved against each other language, as evidence; a quarter of a bit for each, as chunks share their luck.
        score = 1 / sum(2.0 ** (-min(60.0, (s - best) * 0.25)) for s in sizes)
        return self.languages[at], score, margin >= MARGIN, margin


def identify(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, margin of each row of docs."""
    raw = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, training))
    held: dict[int, Classifier] = {}

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        if 0 not in held:
            held[0] = Classifier(raw.value)
        found = [held[0](t.decode()) for t in texts_of(batch.column("text"))]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "accepted", "margin"])

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return arrow_map(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, margin double")


__all__ = ["Classifier", "cleaned", "dictionaries", "identify"]
