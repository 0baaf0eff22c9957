import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import ROWS, clashing, folder, table
from pyspark.sql import functions as F

from lacuna.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=4):
    """lang -> (n, counts of frequent phrases, what is kept of them), by the definition."""
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    kept = {}
    for (lang, *words), a in f.items():
        m = len(words)
        if m < 2:
            continue
        if any(q[0] == lang and len(q) - 1 > m and 100 * c >= 80 * a and any(list(q[1 + i : 1 + i + m]) == words for i in range(len(q) - m)) for q, c in f.items()):
            continue
        cuts = [(2000000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k) for k in range(1, m)]
        score, k = min(cuts)
        kept[lang, *words] = (a, f[lang, *words[:k]], f[lang, *words[k:]], score)
    return {x: c for x, c in n.items() if c}, f, kept


def compare(spark, rows, least):
    phrases, totals = C.frequent_phrases(table(spark, rows), least)
    n, f, kept = plain(rows, least)
    assert {r.lang: r.n for r in totals.collect()} == n
    assert {(r.lang, *r.words): r.f for r in phrases.collect()} == f
    assert {(r.lang, *r.words): (r.a, r.l, r.r, r.score) for r in C.collocations(phrases).collect()} == kept
    return kept


def some_rows(seed, many=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ü", "#", "x1", "-", "字"]
    ends = [" "] * 9 + ["  ", "\t", ". ", ",", "\n", " ; ", "!", "\x0b", "\r\n", " "]
    return [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(25))), rng.choice(["en", "de", None, "", "EN"]), "s") for i in range(many)]


@pytest.mark.parametrize("exact", [C.EXACT, 0])
def test_small_tables(spark, monkeypatch, exact):
    """With groups told one by one, and as a bitmap."""
    monkeypatch.setattr(C, "EXACT", exact)
    assert len(compare(spark, some_rows(1), 3)) > 20


def test_crowded_bitmap(spark, monkeypatch):
    """A bitmap that lets most groups through gives the same results."""
    monkeypatch.setattr(C, "EXACT", 0)
    monkeypatch.setattr(C, "BITS", 6)
    compare(spark, some_rows(2, 30), 3)


def test_hot_phrase_and_blocks(spark, monkeypatch):
    """One phrase fills a third of all rows; blocks of one document each."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 10)
    rows = some_rows(3, 20) + [(100 + i, "hot words come here. hot words come here", "en", "s") for i in range(10)]
    kept = compare(spark, rows, 4)
    assert ("en", "hot", "words", "come", "here") in kept and ("en", "hot", "words") not in kept


def test_overlapping_occurrences_count(spark):
    compare(spark, [(1, "ha ha ha ha ha", "en", "s"), (2, "ha ha, ha", "en", "s")], 2)


def test_order_and_limit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "TOP", 3)
    text = ". ".join(["b c", "a d", "e f", "g h"] * 40)
    rows = C.op11_collocations(spark, folder(table(spark, [(1, text, "en", "s")]), tmp_path)).collect()
    assert sorted((r["rank"], r.phrase, r.score, r.n) for r in rows) == [(1, "a d", 1000000, 320), (2, "b c", 1000000, 320), (3, "e f", 1000000, 320)]


def test_scores_beyond_64_bits(spark):
    big = 10**16
    phrases = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big + 1), ("en", ["a", "b"], big - 1)], "lang string, words array<string>, f long")
    r = C.collocations(phrases).collect()[0]
    assert r.score == 2000000 * (big - 1) // (2 * big + 1)


def test_hash_is_sparks(spark):
    values = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(v),) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert C.xxhash64(values.view(np.uint64)).view(np.int64).tolist() == want


def test_odd_rows(spark, tmp_path):
    rows = C.op11_collocations(spark, folder(clashing(table(spark)), tmp_path)).collect()
    n, _, kept = plain(ROWS, 30)
    assert {(r.lang, *r.phrase.split(" ")): (r.a, r.l, r.r, r.score) for r in rows} == {k: v for k, v in kept.items()}
    assert {(r.lang, r.n) for r in rows} <= set(n.items())


def test_empty_table(spark, tmp_path):
    assert C.op11_collocations(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_a_block_is_cut_into_short_rows(spark):
    """A row per block held all its places at once in readers and workers, 16 rows of it in one batch."""
    rows = [(i, "one two three, four five. " * 3000 + "six " * 300, "en", "s") for i in range(2)] + [(9, None, "en", "s"), (10, "seven", "en", "s")]
    docs = table(spark, rows)
    frequent = C.Frequent.of(C.word_counts(docs).where("n >= 3 AND word IS NOT NULL"))
    sizes = [len(r.place) for r in C.first_relation(docs.coalesce(1), frequent).collect()]
    assert sum(sizes) == 2 * 15_300 and max(sizes) <= C.ROW_PLACES + 300
    assert ("en", "one", "two", "three") in compare(spark, rows, 3)


def test_rows_of_two_blocks_are_no_neighbours():
    """The place that ends a row may be one less than the place that begins the next, of another block."""
    lists = lambda x: C.pa.array(x, C.pa.list_(C.pa.int32()))
    batch = C.pa.RecordBatch.from_arrays([lists([[], [1, 2, 4], [], [5, 6, 7], [8]]), lists([[], [10, 11, 12], [], [13, 14, 15], [16]])], ["place", "id"])
    ((place, left, right, begin),) = C._joined(iter([batch]))
    assert (place.tolist(), left.tolist(), right.tolist(), begin.tolist()) == ([1, 5, 6], [10, 13, 14], [11, 14, 15], [0, 0, 1, 1, 3])
