from pathlib import Path

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ROWS, clashing, folder, table
from tokenizers import Tokenizer

from lacuna.llm import token_counts as T
from lacuna.llm.common import shared_path

VOCABULARY = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
LIBRARY = Tokenizer.from_str(VOCABULARY)


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


PARTS = ["word", "Word", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "'s", "12", "..", "<|endoftext|>", "é", "字", "😀", "x", "\u0301"]
COUNTER = T.ChunkCounter(VOCABULARY)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14), max_size=4))
def test_chunks_count_as_the_whole(texts):
    texts = ["".join(parts) for parts in texts]
    assert COUNTER.counts(texts) == [plain(t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=40))
def test_any_text_counts_as_the_whole(text):
    assert COUNTER.counts([text]) == [plain(text)]


def test_odd_rows(spark, tmp_path):
    rows = T.op9_token_counts(spark, folder(clashing(table(spark)), tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=key)
    want = [(i, len((t or "").encode()), plain(t), plain(t) > 512) for i, t, *_ in ROWS]
    assert got == sorted(want, key=key)


def test_empty_table(spark, tmp_path):
    assert T.op9_token_counts(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_query_equals_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = T.op9_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: plain(t) for i, t in docs.items()}


def test_second_run_encodes_only_misses(spark):
    cache = shared_path(spark, "cache-test")
    docs = table(spark, [(i, f"text {i % 3}", "en", "a") for i in range(9)])
    T.count_tokens(docs, VOCABULARY, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    more = table(spark, [(i, f"text {i}", "en", "a") for i in range(5)])
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(more, VOCABULARY, cache).collect()} == {i: plain(f"text {i}") for i in range(5)}
    assert spark.read.parquet(cache).count() == 5
    # Another vocabulary has another digest, and its own counts.
    other = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    assert T.read_cache(spark, cache, T.vocabulary_digest(other)).count() == 0
