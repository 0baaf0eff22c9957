"""The stored index: same answers as a pass over all chunks, whatever was added and removed."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lacuna.operators import blockmax, search
from lacuna.plans import ask
from lacuna.plans.index import Index

PAGES = "document_id string, page_number int, raw_text string"
QUESTIONS = "query_id string, document_id string, question string"
WORDS = ["plan", "area", "road", "width", "site", "land", "lake", "buffer", "zone", "height", "storey", "parking", "tree", "drain", "valley", "heritage"]
RARE = ["zircon", "quartz", "basalt", "gneiss"]


def some_pages(seed, document, first, last):
    rng = random.Random(seed)
    pages = []
    for p in range(first, last + 1):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(40, 90))]
        if rng.random() < 0.1:
            words += [rng.choice(RARE)] * rng.randrange(1, 5)
        if rng.random() < 0.1:
            words = ["2.1 Lakes: means water"] + words
        rng.shuffle(words)
        pages.append((document, p, "scan" if rng.random() < 0.1 else " ".join(words) + "."))
    return pages


ASKED = ["zircon in a lake buffer", "what is the definition of lakes", "quartz basalt", "gneiss", "parking height storey", "unknown", "zircon zircon quartz"]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(f"{d}{i}", d, q) for d in ("a", "b", "c") for i, q in enumerate(ASKED)], QUESTIONS)


def rows(hits):
    return sorted((r.query_id, r["rank"], r.document_id, r.page_number, r.chunk_ordinal, r.score, r.matched, r.distinctive) for r in hits.collect())


def plain(spark, pages, questions):
    """All chunks scored, nothing stored."""
    chunked = ask.ingest(spark.createDataFrame(pages, PAGES))
    asked = search.query_terms(questions)
    posted = search.relevant_postings(chunked, asked)
    return rows(search.top_hits(search.scores(posted, search.query_weights(posted, asked), questions)))


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / uuid.uuid4().hex), pages_per_block=8)


def files(index):
    return {str(p): p.stat().st_mtime_ns for p in Path(index.folder).rglob("*.parquet")}


def test_same_hits_from_fewer_blocks(spark, index, questions):
    pages = some_pages(1, "a", 1, 400) + some_pages(2, "b", 1, 30)
    index.add(spark.createDataFrame(pages, PAGES))
    found = index.search(questions)
    assert rows(found.hits) == plain(spark, pages, questions) != []
    # Two hits each: most stretches have no page that could be among them.
    found = index.search(questions, k=2)
    assert rows(found.hits) == [r for r in plain(spark, pages, questions) if r[1] <= 2]
    read, there = found.read.count(), found.bounds.count()
    assert read == found.read.distinct().count() and 0 < read < there / 2
    # What was not read could not have come in.
    worst = {r.query_id: r.score for r in found.hits.where("rank = 2").collect()}
    left_out = found.bounds.join(found.read, ["query_id", *blockmax.STRETCH], "left_anti").collect()
    assert left_out and all(r.bound < worst[r.query_id] for r in left_out)


def test_bounds_hold(spark, index, questions):
    index.add(spark.createDataFrame(some_pages(3, "a", 1, 120), PAGES))
    found = index.search(questions, k=10_000)
    best = found.hits.withColumn("block", F.floor(F.col("page_number") / 8)).groupBy("query_id", "document_id", "block").agg(F.max("score").alias("best"))
    checked = best.join(found.bounds, ["query_id", "document_id", "block"], "left").collect()
    assert len(checked) > 20 and all(r.best <= r.bound + 1e-4 for r in checked)


def test_add_add_remove_add_equals_a_rebuild(spark, index, questions):
    one, two = some_pages(4, "a", 1, 60) + some_pages(5, "b", 1, 40), some_pages(6, "a", 61, 100) + some_pages(7, "c", 1, 50)
    index.add(spark.createDataFrame(one, PAGES))
    before = files(index)
    index.add(spark.createDataFrame(two, PAGES))
    assert before.items() <= files(index).items()
    index.remove(spark.createDataFrame([("b",), ("c",), ("c",)], "document_id string"))
    assert before.items() <= files(index).items()
    rest = [p for p in one + two if p[0] == "a"]
    again = some_pages(8, "b", 1, 25)
    index.add(spark.createDataFrame(again, PAGES))
    want = plain(spark, rest + again, questions)
    assert rows(index.search(questions).hits) == want
    old = index.compact()
    assert len(old) == 3 and len(index.segments()) == 1
    assert rows(index.search(questions).hits) == want
    assert index.live("totals").count() == 2
    index.remove(spark.createDataFrame([("a",)], "document_id string"))
    assert {r.document_id for r in index.live("chunks").select("document_id").distinct().collect()} == {"b"}


def test_a_broken_off_upload_is_not_read(spark, index, questions, monkeypatch):
    pages = some_pages(9, "a", 1, 40)
    index.add(spark.createDataFrame(pages, PAGES))
    with monkeypatch.context() as m:
        m.setattr(Index, "_note_segment", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(spark.createDataFrame(some_pages(10, "a", 41, 80), PAGES))
    assert rows(index.search(questions).hits) == plain(spark, pages, questions)
    index.add(spark.createDataFrame(some_pages(11, "b", 1, 20), PAGES))
    assert len(index.segments()) == 2


def test_answers_and_evidence(spark, index, questions):
    pages = some_pages(12, "a", 1, 90)
    index.add(spark.createDataFrame(pages, PAGES))
    found = ask.answer(ask.ingest(spark.createDataFrame(pages, PAGES)), questions)
    key = lambda r: (r.query_id, r["rank"], r.page_number, r.chunk_ordinal, tuple(r.matched_terms))
    assert sorted(map(key, index.answers(questions).collect())) == sorted(map(key, found.hits.collect())) != []
    assert all(r.quote and r.why_matched.startswith("Matched on: ") for r in index.evidence(questions).collect())


def test_nothing_added_and_nothing_asked(spark, index, questions):
    with pytest.raises(ValueError, match="nothing was added"):
        index.search(questions)
    index.add(spark.createDataFrame([], PAGES))
    assert index.search(questions).hits.count() == 0
    index.add(spark.createDataFrame([(None, 1, "x" * 200), ("a", 2, None)], PAGES))
    assert index.search(questions).hits.count() == 0
    assert index.search(questions.limit(0)).hits.count() == 0


def test_only_shared_stretches_are_merged(spark):
    """Compaction grouped the postings of all blocks; a stretch of one version needs none of it."""
    from lacuna.operators import blockmax

    post = "array<struct<page_number:int,chunk_ordinal:int,tf:long,length:int,defines:boolean>>"
    rows = [("d", 0, "a", 2, 3, 5, False, [(1, 0, 3, 5, False)], 1), ("d", 0, "a", 1, 4, 4, True, [(2, 0, 4, 4, True)], 2),
            ("d", 1, "a", 1, 1, 9, False, [(40, 0, 1, 9, False)], 1), ("e", 0, "b", 1, None, None, None, [], 2), ("d", None, "c", 1, 1, 1, False, [(None, 0, 1, 1, False)], 1),
            ("d", None, "c", 2, 1, 1, False, [(None, 1, 1, 1, False)], 2)]
    blocks = spark.createDataFrame(rows, f"document_id string, block long, term string, df long, max_tf long, min_length int, defines boolean, posts {post}, version long")
    assert {tuple(r) for r in blockmax.shared_stretches(blocks).collect()} == {("d", 0), ("d", None)}
    got = {(r.document_id, r.block, r.term): (r.df, r.max_tf, r.min_length, r.defines, len(r.posts)) for r in blockmax.merged(blocks).collect()}
    assert got == {("d", 0, "a"): (3, 4, 4, True, 2), ("d", 1, "a"): (1, 1, 9, False, 1), ("e", 0, "b"): (1, None, None, None, 0), ("d", None, "c"): (3, 1, 1, False, 2)}


TOKENS = "document_id string, page_number long, chunk_ordinal int, readable boolean, defines boolean, terms array<string>, length int"


def plain_blocks(rows, pages_per_block):
    """(document, stretch, term) -> df, max_tf, min_length, defines, terms and posts, by the definition."""
    tf = {}
    for d, p, o, readable, defines, terms, length in rows:
        for t in terms or []:
            if d is not None:
                chunk = (d, p, o, readable, defines, length)
                tf.setdefault((d, None if p is None else p // pages_per_block, t), {}).setdefault(chunk, [0])[0] += 1
    out = {}
    for key, chunks in tf.items():
        shown = [(c, n) for c, (n,) in chunks.items() if c[3]]
        known = [c[4] for c, _ in shown if c[4] is not None]
        out[key] = (len(chunks), max((n for _, n in shown), default=None), min((c[5] for c, _ in shown), default=None), any(known) if known else None,
                    sum(n for n, in chunks.values()), sorted((repr(c[1]), repr(c[2]), n, c[5], repr(c[4])) for c, n in shown))
    return out


def as_plain(blocks):
    return {(r.document_id, r.block, r.term): (r.df, r.max_tf, r.min_length, r.defines, r.terms, sorted((repr(p.page_number), repr(p.chunk_ordinal), p.tf, p.length, repr(p.defines)) for p in r.posts))
            for r in blocks.collect()}


@pytest.mark.parametrize("held", [1, 40, 1 << 18])
def test_blocks_and_totals_by_the_definition(spark, held):
    """Chunks come twice, with null numbers, without terms, and from several batches; totals need no second look at the text."""
    rng = random.Random(held)
    rows = []
    for i in range(150):
        terms = rng.choice([None, [], *[[rng.choice(["a", "b", "ü", "c1"]) for _ in range(rng.randrange(1, 9))] for _ in range(6)]])
        rows.append((rng.choice(["d", "e", None]), rng.choice([None, *range(20)]), rng.choice([None, 0, 700]), rng.random() < 0.8, rng.choice([True, False, None]), terms, None if terms is None else len(terms)))
    rows += rows[:40]
    blocks = blockmax.block_postings(spark.createDataFrame(rows, TOKENS), 4)
    assert as_plain(blocks) == plain_blocks(rows, 4) != {}
    # In the order in which Spark hands them over, in batches that end within stretches.
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: [(x is not None, x) for x in (r[0], None if r[1] is None else r[1] // 4, r[1], r[2], r[3], r[4], r[6])])
    columns = {"document_id": [r[0] for r in order], "block": [None if r[1] is None else r[1] // 4 for r in order], "page_number": [r[1] for r in order], "chunk_ordinal": [r[2] for r in order],
               "readable": [r[3] for r in order], "defines": [r[4] for r in order], "length": [r[6] for r in order], "terms": [r[5] for r in order]}
    pa = blockmax.pa
    kinds = pa.schema([("document_id", pa.string()), ("block", pa.int64()), ("page_number", pa.int64()), ("chunk_ordinal", pa.int32()), ("readable", pa.bool_()), ("defines", pa.bool_()), ("length", pa.int32()), ("terms", pa.list_(pa.string()))])
    table = pa.table(columns, kinds)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(blockmax, "HELD_TERMS", held)
        m.setattr(blockmax, "BLOCK_ROWS", 3)
        got = [r for b in blockmax._counted(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert len(got) == len(plain_blocks(rows, 4))
    assert {(r["document_id"], r["block"], r["term"]): (r["df"], r["terms"], len(r["posts"])) for r in got} == {k: (v[0], v[4], len(v[5])) for k, v in plain_blocks(rows, 4).items()}
    totals = {r.document_id: (r.n, r.terms) for r in blockmax.document_totals(spark.createDataFrame(rows, TOKENS), blocks).collect()}
    assert totals == {d: (sum(r[0] == d for r in rows), sum(len(r[5] or []) for r in rows if r[0] == d)) for d in ("d", "e")}
