import random
import re
from itertools import combinations

import numpy as np
import pytest
from odd_rows import ROWS, clashing, folder, table

from lacuna.llm import similarity as S
from lacuna.llm.links import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(docs, percent=80):
    """(doc_id, n_shingles, component_id) of docs with ids of their own, by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        x, y = sets[i], sets[j]
        if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent and root(i) != root(j):
            both = len(x & y)
            if both * 100 >= (len(x) + len(y) - both) * percent:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[root(i)] = min(least.get(root(i), d[0]), d[0])
    return [(d[0], len(sets[i]), least.get(root(i)) if sets[i] else d[0]) for i, d in enumerate(docs)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(spark, path):
    return sorted((tuple(r) for r in S.op4_ngram_jaccard_join(spark, path).collect()), key=key)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 5, 200, 300, 900, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for keep in (0.0, 0.5, 0.9, 1.0):
            y = np.unique(np.concatenate([x[: int(keep * len(x))], rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
            apart = S.least_apart(S.sketch(x), S.sketch(y))
            assert apart <= len(np.setxor1d(x, y)) and apart == S.least_apart(S.sketch(y), S.sketch(x))
        assert S.least_apart(S.sketch(x), S.sketch(x)) == 0
        other = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert n < 100 or S.least_apart(S.sketch(x), S.sketch(other)) > 2 * n / 9


def test_odd_rows(spark, tmp_path):
    docs = ROWS + [(None, "same text twice", "x", "x"), (40, "SAME  text\ntwice", "x", "x"), (41, "a b c d e f g h i j k l m", "x", "x"), (42, "a b c d e f g h i j k l m n", "x", "x")]
    assert run(spark, folder(clashing(table(spark, docs)), tmp_path)) == sorted(plain(docs), key=key)


def test_empty_table(spark, tmp_path):
    assert run(spark, folder(table(spark, []), tmp_path)) == []


def family(rng, size, words, edits):
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_around_the_threshold(spark, tmp_path, monkeypatch, seed):
    """Families whose members sit on both sides of the threshold, and a passage that all share."""
    monkeypatch.setattr(S, "COMMON", 6)
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for _ in range(8) for t in family(rng, 14, 120, 5)]
    texts += [f"{passage} " + " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 80))) for _ in range(60)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rng.shuffle(texts)
    docs = [(i, t, "x", "x") for i, t in enumerate(texts)]
    got = run(spark, folder(table(spark, docs), tmp_path))
    assert got == sorted(plain(docs)) and len({c for *_, c in got}) < len(got) - 40


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, "/root/testdata/sf0.01") == sorted(plain(docs))


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    nodes = list(range(200))
    rng.shuffle(nodes)
    links = list(zip(nodes[:99], nodes[1:100], strict=True)) + list(zip(nodes[100:], nodes[101:], strict=False)) + [(5000, 6000)]
    got = {r.key: r.group for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low, high = min(nodes[:100]), min(nodes[100:])
    assert got == {**{n: low for n in nodes[:100]}, **{n: high for n in nodes[100:]}, 5000: 5000, 6000: 5000}


def test_nothing_to_link(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
