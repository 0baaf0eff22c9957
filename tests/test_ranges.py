"""Order-dependent operators against plain Python, across many small buckets."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from lacuna.operators import pages as P
from lacuna.operators.evaluation import order_statistics
from lacuna.operators.ranges import dealt_by_order, islands, latest_before, number_rows, rank_rows


def test_islands_and_numbers_across_buckets(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else "k", p) for p in range(600) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, at long")
    got = sorted((r.key, r.page_start, r.page_end) for r in islands(df, "key", "at", width=8).collect())
    expect = []
    for key in ("hot", "k"):
        for p in sorted(p for k, p in rows if k == key):
            if expect and expect[-1][0] == key and expect[-1][2] == p - 1:
                expect[-1][2] = p
            else:
                expect.append([key, p, p])
    assert got == sorted(tuple(e) for e in expect)
    numbered = {(r.key, r.at): r.n for r in number_rows(df, "key", "at", "n", width=8).collect()}
    for key in ("hot", "k"):
        for i, p in enumerate(sorted(p for k, p in rows if k == key), 1):
            assert numbered[(key, p)] == i


def test_rank_rows_orders_by_columns_then_position(spark):
    rng = random.Random(6)
    rows = [("q", rng.randint(0, 3), float(rng.randint(0, 4)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, a int, b double, at long")
    got = {r.at: r.rank for r in rank_rows(df, "key", [("a", True), ("b", False)], "at", "rank").collect()}
    for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[3])), 1):
        assert got[r[3]] == i


def test_as_of_across_buckets(spark):
    rng = random.Random(8)
    left = [("u%d" % (i % 2), rng.randint(0, 300), i) for i in range(150)]
    right = [("u%d" % (i % 3), rng.randint(0, 300), i) for i in range(30)]
    l = spark.createDataFrame(left, "u string, at long, id long")
    r = spark.createDataFrame(right, "u string, at long, v long")
    got = {x.id: x.hit for x in latest_before(l, r, "u", "at", "v", "hit", width=16).collect()}
    assert len(got) == 150
    for u, at, i in left:
        before = [(p, v) for k, p, v in right if k == u and p <= at]
        assert got[i] == (max(before)[1] if before else None)


def test_null_keys_and_positions_are_kept(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 3), (None, 9), ("a", 7)], "key string, at long")
    got = {(r.key, r.at): r.n for r in number_rows(df, "key", "at", "n", width=4).collect()}
    assert got == {("a", None): 1, ("a", 5): 2, ("a", 7): 3, (None, 3): 1, (None, 9): 2}
    ranked = {(r.key, r.at): r.n for r in rank_rows(df.withColumn("g", df["at"] % 2), "key", [("g", False)], "at", "n").collect()}
    assert len(ranked) == 5 and ranked[None, 3] == 1


def test_ranks_of_one_hot_question(spark):
    """100,000 regions of one question, nearly all with a score of their own: no part above twice the median."""
    df = spark.range(100_000).select(F.lit("q").alias("key"), (F.xxhash64("id") % 1_000_003 / 7).alias("score"), "id")
    df = df.unionAll(spark.range(50).select(F.lit("other").alias("key"), F.lit(1.0).alias("score"), "id")).repartition(8)
    ranked = rank_rows(df, "key", [("score", True)], "id", "rank")
    rows = [(r.score, r.id, r["rank"]) for r in ranked.where("key = 'q'").collect()]
    assert [r[2] for r in sorted(rows, key=lambda r: (-r[0], r[1]))] == list(range(1, 100_001))
    assert sorted(r["rank"] for r in ranked.where("key = 'other'").collect()) == list(range(1, 51))
    with_parts = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in with_parts}
    try:
        for k, v in with_parts.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in dealt_by_order(df, [F.col("key"), F.col("score").desc(), F.col("id")]).groupBy("_part").count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 8 and max(sizes) <= 2 * median(sizes)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_order_statistics(spark, kind):
    rng = random.Random(12)
    if kind == "double":
        shapes = [[rng.gauss(0, 1) for _ in range(500)], [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(300)],
                  [1.0, float("inf"), float("-inf"), -0.0, 0.0, 5e-324, 1e-320], [7.5] * 400 + [7.5 + 2**-50], [3.0], [0.0, 0.0, 4.0]]
    else:
        shapes = [[rng.randrange(-(2**63), 2**63) for _ in range(500)], [2**62 + i % 3 for i in range(200)], [0] * 50 + [1], [-5, -1, -900000], [2**63 - 1, -(2**63)]]
    rows = [(f"k{i}", v) for i, vs in enumerate(shapes) for v in vs] + [("none", None), (None, shapes[0][0]), ("k0", None)]
    rows += [("nan", float("nan"))] if kind == "double" else []
    places = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "late": lambda n: F.least(n - 1, F.floor(0.95 * n)), "last": lambda n: n - 1}
    got = {r[0]: tuple(r[1:]) for r in order_statistics(spark.createDataFrame(rows, f"key string, v {kind}"), "key", "v", places, buckets=16).collect()}
    want = {None: (1, *[shapes[0][0]] * 4)}
    for i, vs in enumerate(shapes):
        vs, n = sorted(vs), len(vs)
        want[f"k{i}"] = (n, vs[0], vs[n // 2], vs[min(n - 1, int(0.95 * n))], vs[-1])
    assert got == want


def test_runs_grade_nothing_else(spark):
    """Whether a page is unreadable was asked of its whole grade, with each text repaired and searched."""
    pages = [("d", i, "x" * n) for i, n in enumerate([200, 119, 0, 120, 5, 200, 3], 1)] + [("d", 8, None), ("e", 1, " " * 300)]
    graded = P.grade_pages(spark.createDataFrame(pages, "document_id string, page_number int, raw_text string"))
    runs = P.unreadable_runs(graded)
    assert sorted(map(tuple, runs.collect())) == [("d", 2, 3, 2), ("d", 5, 5, 1), ("d", 7, 8, 2), ("e", 1, 1, 1)]
    assert sorted(map(tuple, P.unreadable_runs(graded.drop("raw_text")).collect())) == sorted(map(tuple, runs.collect()))
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "translate" not in plan


def test_first_ranks_only(spark):
    """Rows of buckets that begin beyond the last rank asked for are not dealt out."""
    rows = [(k, p) for k in ("a", "b", None) for p in [None, *range(0, 60, 2)]]
    df = spark.createDataFrame(rows, "k string, p long")
    every = {(r.k, r.p, r.n) for r in number_rows(df, "k", "p", "n", width=8).collect()}
    for up_to in (1, 6, 100):
        assert {(r.k, r.p, r.n) for r in number_rows(df, "k", "p", "n", width=8, up_to=up_to).collect()} == {r for r in every if r[2] <= up_to}
