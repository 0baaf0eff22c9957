import hashlib
import math
import random
import re
from collections import Counter

import pytest
from odd_rows import ROWS, clashing, table

from lacuna.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    words, hit, ids = split(text), set(), set()
    for item_id, item in items:
        w = split(item)
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if k else ():
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[s : s + k]:
                    hit.update(range(i, i + k))
                    ids |= {str(item_id)} if item_id is not None else set()
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEM = "The quick brown fox jumps over the lazy dog and then Sleeps under an old Äpple tree"
ITEMS = [(1, ITEM), (2, "two words"), (11, ITEM + " again"), (3, None), (4, ""), (None, "nobody owns this item of few words"), (2, "two words"), (5, "the the the the the the the the the the the"), (6, "absent zzz"), (7, "same")]
DOCS = ROWS + [
    (20, "so " + ITEM.upper().replace("Ä", "Ä") + " end", "en", "a"),
    (21, "the quick brown fox jumps over the lazy dog and THEN! sleeps under", "en", "a"),
    (22, "the quick brown fox jumps over the lazy dog or then sleeps under an old äpple tree", "en", "a"),
    (23, "two two words two words words", "en", "a"),
    (24, "nobody owns this item of few words " + "the " * 25, "en", "a"),
    (25, "then sleeps under an old Äpple tree and the lazy dog and then sleeps under an old Äpple tree", "en", "a"),
]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def run(spark, tmp_path, docs, items):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    items.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return sorted((tuple(r) for r in D.op7_benchmark_decontamination(spark, str(tmp_path)).collect()), key=key)


def near_ids(text, items):
    """Ids of items that stand in the text in other words, and not as they are under the same id."""
    found = [(str(i), near(text, t)) for i, t in items if i is not None]
    ids = sorted({i for i, m in found if m == "near"} - {i for i, m in found if m == "exact"})
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    got = run(spark, tmp_path, clashing(table(spark, DOCS)), clashing(spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("id", D.F.lit(1))))
    assert got == sorted(((i, *plain(t, ITEMS), *near_ids(t, ITEMS)) for i, t, *_ in DOCS), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_few_words(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd"]
    some = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
    items = [(i, some(1, 16)) for i in range(12)] + [(50, "a b a b a b a b a b a b a b")]
    docs = [(i, some(0, 60) + (" " + rng.choice(items)[1] if rng.random() < 0.5 else ""), "en", "a") for i in range(60)] + [(99, "a b " * 30, "en", "a")]
    got = run(spark, tmp_path, table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got == sorted(((i, *plain(t, items), *near_ids(t, items)) for i, t, *_ in docs), key=key)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(spark, tmp_path / "a", table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")) == []
    got = run(spark, tmp_path / "b", table(spark), none)
    assert got == sorted(((i, *plain(t, []), *near_ids(t, [])) for i, t, *_ in ROWS), key=key)


def test_proximity_finds_other_orders(spark):
    docs = table(spark, [(1, "brown quick the fox over jumps the lazy dog then and sleeps under old an tree Äpple", "en", "a"), (2, "nothing like it, the end", "en", "a")])
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.matches(docs, benchmark).count() == 0
    found = D.find_all(docs, benchmark)
    assert found.exact.count() == 0 and {r.doc_id for r in found.near.collect()} == {1}


def test_places_joined_instead_of_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", 0)
    got = run(spark, tmp_path, table(spark, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got == sorted(((i, *plain(t, ITEMS), *near_ids(t, ITEMS)) for i, t, *_ in DOCS), key=key)


def test_clean_documents_with_and_without_near(spark):
    docs = table(spark, [(1, ITEM, "en", "a"), (2, ITEM.replace("jumps", "leaps").replace("tree", "bush"), "en", "a"), (3, "nothing like it", "en", "a")])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = lambda **k: {r.doc_id for r in D.clean_documents(docs, items, **k).collect()}
    assert kept(width=13) == {2, 3} and kept(width=13, near=True) == {3}


def test_no_python_on_the_main_path(spark):
    plan = D.op7_benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.split("== Physical Plan ==")[1])


def near(text, item, share=0.8):
    """'exact', 'near' or None, by comparing all windows with all stretches."""
    w, d = split(item), split(text)
    k = min(10, len(w))
    need, best = math.ceil(round(k * share, 6)), 0
    for s in range(len(w) - k + 1) if k else ():
        for i in range(max(len(d) - k, 0) + 1):
            if d[i : i + k] == w[s : s + k]:
                return "exact"
            best = max(best, (Counter(d[i : i + k]) & Counter(w[s : s + k])).total())
    return "near" if k and best >= need else None


def near_rows(spark, tmp_path, docs, items):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    items.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(((r.doc_id, r.item_id, r.match) for r in D.benchmark_matches(spark, str(tmp_path)).collect()), key=str)


def plain_rows(docs, items):
    found = {(i, t, None if n is None else str(n), x): near(t, x) for i, t, *_ in docs for n, x in items}
    return sorted(((i, n, m) for (i, _, n, _), m in found.items() if m), key=str)


def test_reworded_items_are_near_matches(spark, tmp_path):
    items = [(1, ITEM), (2, "lazy dogs never answered quixotic letters"), (3, "no such words anywhere"), (None, "nobody owns this item of few words")]
    docs = ROWS + [
        (30, "the quick brown fox leaps over the lazy dog and then dozes under an old äpple tree", "en", "a"),
        (31, "lazy dogs never answered letters", "en", "a"),
        (32, "the lazy dogs never answered odd letters", "en", "a"),
        (33, "nobody owns this thing of few words", "en", "a"),
        (34, ITEM, "en", "a"),
        (35, "lazy dogs never", "en", "a"),
    ]
    got = near_rows(spark, tmp_path, clashing(table(spark, docs)), clashing(spark.createDataFrame(items, "item_id long, text string")))
    # No text has the word "quixotic"; the item is found by the words that texts have.
    assert got == plain_rows(docs, items) and {(30, "1", "near"), (31, "2", "near"), (32, "2", "near"), (33, None, "near"), (34, "1", "exact")} <= set(got)
    assert not {35} & {i for i, *_ in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matches_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    some = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
    items = [(i, some(1, 25) + rng.choice(["", " absent"])) for i in range(20)]

    def reworded(text):
        return " ".join(rng.choice(words + ["odd"]) if rng.random() < 0.15 else w for w in text.split())

    docs = [(i, some(0, 8) + " " + reworded(rng.choice(items)[1].replace("absent", "")) + " " + some(0, 8), "en", "a") for i in range(60)]
    got = near_rows(spark, tmp_path, table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain_rows(docs, items) and {"near", "exact"} == {m for *_, m in got}
