"""Token counts through a cache of digests.

A text is known by the digest of its content, a tokenizer by the digest of its
vocabulary file.  Counts already stored are joined; of the misses, one text per
digest is encoded, and the counts are appended to the cache.

Copies are merged before and after the shuffle of the texts, so a text that fills a
third of all rows is moved once per input partition and encoded once.  Null texts
count as empty, which have no tokens.  A very long text is encoded whole, in memory in
proportion to its length; an empty table gives an empty result and a cache as it was;
counts have no ties.  Only `doc_id` and `text` are read.
"""

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lacuna.llm.common import exists, read, shared_path, whole_text

LIMIT = 512
CACHE = "tokenizer string, digest string, n_tokens long"
#: Texts handled at once, and chunks whose counts a task remembers before it starts afresh.
BATCH = 64
MEMO = 250_000


class ChunkCounter:
    """Counts of whole texts, as the tokenizer gives them, encoding most words once.

    A byte-level vocabulary splits a text by its pattern first, and no token spans
    the place before a space that stands between two characters other than white
    space.  Texts are cut there, so a count is a sum over chunks, most of which were
    seen before.  New chunks are encoded together, joined as they would stand in a
    text; each token belongs to the chunk in which it ends.  Other texts, where
    white space meets a space, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[str, int] = {}

    @staticmethod
    def _chunks(text: str) -> list[str] | None:
        """The parts between the spaces, or None if one of them begins or ends with white space."""
        parts = text.split(" ")
        return None if any(not p or p[0].isspace() or p[-1].isspace() for p in parts) else parts

    def _learn(self, parts: list[str]) -> None:
        text = " " + " ".join(parts)
        ends = np.cumsum([1 + len(p) for p in parts])
        tokens = [end for _, end in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        counts = np.bincount(np.searchsorted(ends, tokens), minlength=len(parts))
        self.known.update(zip(parts, counts.tolist(), strict=True))

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(c) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self._chunks(t) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        # The first chunk of a text has no space before it, so it is another chunk.
        new = list({p for parts in cut if parts for p in parts[1:]} - self.known.keys())
        for at in range(0, len(new), 2000):
            self._learn(new[at : at + 2000])
        first = self._whole([t if parts is None else parts[0] for t, parts in zip(texts, cut, strict=True)])
        return [n if parts is None else n + sum(map(self.known.__getitem__, parts[1:])) for n, parts in zip(first, cut, strict=True)]


def encode_distinct(texts: DataFrame, vocabulary: str) -> DataFrame:
    """digest and n_tokens of (digest, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = ChunkCounter(shared.value)
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": counter.counts(part["text"].tolist())})

    return texts.select("digest", "text").mapInPandas(encode, "digest string, n_tokens long")


def vocabulary_digest(vocabulary: str) -> str:
    return hashlib.sha256(vocabulary.encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer.

    Two runs may have appended the same digest; both found the same count.
    """
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest string, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digested(docs: DataFrame, normalise: Column | None = None) -> DataFrame:
    """Add `text` normalised and its `digest`.

    By default only null becomes empty: this library's tokenizers see every byte, so
    no other normal form keeps their counts.
    """
    return docs.withColumn("text", whole_text() if normalise is None else normalise).withColumn("digest", F.sha2("text", 256))


def fill_cache(docs: DataFrame, vocabulary: str, cache: str) -> None:
    """Encode what the cache lacks, one text per digest, and append the counts."""
    tokenizer = vocabulary_digest(vocabulary)
    distinct = docs.groupBy("digest").agg(F.first("text").alias("text"))
    if exists(docs.sparkSession, cache):
        distinct = distinct.join(read_cache(docs.sparkSession, cache, tokenizer), "digest", "left_anti")
    new = encode_distinct(distinct, vocabulary)
    new.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, normalise: Column | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; the cache then holds every digest.

    Rows are joined to counts by digest, without their texts; adaptive execution
    splits a digest that holds many rows.
    """
    rows = digested(docs.select("doc_id", "text"), normalise)
    fill_cache(rows, vocabulary, cache)
    counts = read_cache(docs.sparkSession, cache, vocabulary_digest(vocabulary))
    return rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest").drop("digest")


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    """Starts from an empty cache on each call, so that its work grows with the table."""
    vocabulary = Path(vocabulary_file or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    counted = count_tokens(read(spark, sf_dir, "documents"), vocabulary, shared_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op9_token_counts": (op9_token_counts, None)}
