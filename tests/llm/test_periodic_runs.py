import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ROWS, clashing, folder, table
from pyspark.sql import functions as F

from lacuna.llm import periodic_runs as P
from lacuna.llm.words import SPACE, word_spans


def plain_runs(words):
    """By the definition: for every period, stretches as long as they go; the smallest period of each counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(texts):
    _, _, _, hashes, first = word_spans(texts, SPACE, lower=False)
    runs, drop = P.runs_of(hashes, first)
    return [([tuple(r[1:]) for r in runs.tolist() if r[0] == i], drop[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]


def agrees(texts):
    for t, (runs, drop) in zip(texts, found(texts), strict=True):
        words = re.findall("[^ \t-\r]+", t or "")
        assert runs == plain_runs(words), t
        assert [w for w, d in zip(words, drop, strict=True) if not d] == plain_kept(words, runs)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=4))
def test_two_letters(words):
    agrees([" ".join(w) for w in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", max_size=7), st.integers(1, 9)), max_size=6), max_size=3))
def test_repeated_blocks(texts):
    agrees([" ".join("".join(block * n for block, n in t)) for t in texts])


def test_suffix_order_and_shared_words():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 30))] for _ in range(4)]
        words = np.array([10 * t + w for t, ws in enumerate(texts) for w in ws], np.int64)
        end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        if not len(words):
            continue
        order, shared = P.suffix_order(words, end)
        rests = [words[i : end[i]].tolist() for i in order]
        assert rests == sorted(rests)
        for x, (a, b) in enumerate(zip(rests, rests[1:], strict=False), 1):
            same = next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))
            assert shared[x] == same


def test_fibonacci_and_nested_runs():
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    agrees([" ".join(b), " ".join("aab" * 7 + "aab" * 2 + "c" + ("xy" * 6 + "z") * 3)])


def test_many_left_words_stay_fast():
    """A line that comes 3,000 times, each time behind another word; and one word 200,000 times."""
    line = "one two three four five six seven eight nine ten"
    texts = [" ".join(f"n{i} {line}" for i in range(3000)), " ".join(["word"] * 200_000), " ".join(f"n{i % 7} {line}" for i in range(3000))]
    start = time.perf_counter()
    got = found(texts)
    assert time.perf_counter() - start < 20
    assert got[0][0] == [] and got[1][0] == [(0, 200_000, 1)] and got[2][0] == [(0, 33_000, 77)]


def planted(doc_id, text):
    words = re.findall("[^ \t-\r]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), s, n, q, None if n is None else 1000 * n // q,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(plain_kept(words, runs))))


def test_odd_rows(spark, tmp_path):
    short = [r for r in ROWS if len(r[1] or "") < 10_000]
    rows = [tuple(r) for r in P.op12_periodic_runs(spark, folder(clashing(table(spark)), tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted((r for r in rows if r[0] != 5), key=key) == sorted((row(i, t) for i, t, *_ in short), key=key)


def test_empty_table(spark, tmp_path):
    assert P.op12_periodic_runs(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 8000).collect()
    rows = {r.doc_id: tuple(r) for r in P.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(docs) > 150
    for d in docs:
        assert rows[d.doc_id] == row(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in rows.values()) > 10


def test_all_runs_are_rows(spark):
    docs = table(spark, [(1, "a b c " * 5 + "d", "en", "a"), (2, "no run here", "en", "a")])
    assert [tuple(r) for r in P.all_runs(docs).collect()] == [(1, 0, 15, 3)]
