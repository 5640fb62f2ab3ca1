"""Token counts through a digest cache (operator 2).

Texts are normalised (null becomes the empty text; nothing else can change without changing the counts) and known by
their SHA-256. Stored counts are looked up by content digest and tokenizer digest; only distinct misses are encoded,
and their counts are appended to the cache.

Defined results: a null or empty text has 0 tokens; repeated rows and equal texts share one cache row; an empty table
gives an empty result; other columns are ignored; a very long text is encoded in parts cut where the vocabulary's
own pre-tokenizer always cuts, so its count is that of the whole text.
"""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import arrow_map, shared_dir, texts_of, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: A vocabulary file is a fixed input; this bound is checked before it is broadcast.
MOST_VOCABULARY_BYTES = 64 << 20
PART_CHARS = 1_000_000
_SAFE_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
_loaded: dict[str, object] = {}


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """The text in parts of about `most` characters, cut before a single space between two ASCII letters.

    Byte-level pre-tokenizers take " word" as one piece, so no token spans such a cut; special strings hold no space.
    """
    out, start = [], 0
    while len(text) - start > most and (cut := _SAFE_CUT.search(text, start + most)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class Counter:
    """Counts tokens with the library and vocabulary file named; shipped to executors with the file's bytes."""

    def __init__(self, path: str):
        data = Path(path).read_bytes()
        if len(data) > MOST_VOCABULARY_BYTES:
            raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_VOCABULARY_BYTES} are broadcast")
        self.kind = "sentencepiece" if str(path).endswith(".model") else "tokenizers"
        self.data = data
        version = __import__(self.kind).__version__
        self.digest = hashlib.sha256(f"{self.kind} {version}\n".encode() + data).hexdigest()

    def _load(self):
        if self.digest not in _loaded:
            if self.kind == "sentencepiece":
                import sentencepiece

                _loaded[self.digest] = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            else:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_str(self.data.decode())
                tokenizer.no_truncation()
                tokenizer.no_padding()
                _loaded[self.digest] = tokenizer
        return _loaded[self.digest]

    def splits_safely(self) -> bool:
        return self.kind == "tokenizers" and "ByteLevel" in repr(self._load().pre_tokenizer) and self._load().normalizer is None

    def __call__(self, texts: list[str]) -> list[int]:
        model = self._load()
        if self.kind == "sentencepiece":
            return [len(model.encode(t)) for t in texts]
        out, safe = [], self.splits_safely()
        for start in range(0, len(texts), 64):
            pieces = [parts(t) if safe else [t] for t in texts[start : start + 64]]
            counts = iter([len(e) for e in model.encode_batch([p for ps in pieces for p in ps], add_special_tokens=False)])
            out += [sum(next(counts) for _ in ps) for ps in pieces]
        return out


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; a digest that two runs stored at once is read once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs; new counts are appended to the cache folder."""
    spark = docs.sparkSession
    counter = Counter(vocabulary)
    tokenizer = counter.digest
    cache = cache or f"{shared_dir(spark)}/token-counts"
    shared = spark.sparkContext.broadcast(counter)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # One text for each digest: copies meet in the map-side aggregate, so that a hot text is not moved copy by copy.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = shared.value([t.decode() for t in texts_of(batch.column("text"))])
        return pa.record_batch([pa.array([tokenizer] * len(counts)), batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    arrow_map(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # As a table of its own, so that both sides of the join are plain exchanges and a hot digest is split at run time.
    counts = written(read_cache(spark, cache, tokenizer), "counts")
    sizes = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
