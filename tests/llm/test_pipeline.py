import numpy as np
from odd_rows import ROWS, clashing, table
from test_decontamination import plain as contamination
from test_similarity import plain as components

import corpus_pipeline as C
from lacuna.llm import pieces, secrets, toxicity


def brute(rows, benchmark, predicted):
    """Ids that stay, by comparing everything with everything."""
    left = [r for r in rows if not predicted[r[0]]]
    left = [r for r, (i, n, c) in zip(left, components(left), strict=True) if n == 0 or i == c]
    return [r for r in left if not contamination(r[1], benchmark)[-1]]


def test_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    predicted = {i: model.scores(toxicity.text_features([t]))[0] >= 0.5 for i, t in rows}
    want = brute(rows, benchmark, predicted)
    out = C.run(spark, sf)
    assert out.columns == [*docs.columns, "piece_ids", "round_trip"]
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == sorted(i for i, _ in want) and 0 < len(got) < len(rows)
    coder = pieces.Coder(pieces.public_vocabulary())
    for i, t in want:
        r = got[i]
        assert r.round_trip and coder.decode(np.array(r.piece_ids, np.int64)) == r.text and r.n_chars == len(r.text)
        assert r.text == t or secrets.find(t)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = clashing(table(spark))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing odd about them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for n, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, out, str(tmp_path))
        assert out.columns == [*docs.columns, *(["piece_ids", "round_trip"] if n == 4 else [])]
        out = C.stored(out, "tested-stage")
    key = lambda x: (x is None, x or 0)
    # Row 1 has the passage; of the three copies the first stays; rows without words all stay.
    assert sorted((r.doc_id for r in out.collect()), key=key) == [2, 3, 4, 5, 6, 8, 9, None, None]


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "one two three four five six", "en", "a")] * 3 + [(2, "", "en", "a")] * 2 + [(None, "a b c d e f", "en", "a")] * 2 + ROWS[:1]
    kept = C.drop_near_copies(spark, table(spark, rows), str(tmp_path)).collect()
    assert sorted((r.text for r in kept), key=str) == sorted(["one two three four five six", "", "", "a b c d e f", ROWS[0][1]])


def test_rows_without_words_keep_all_their_columns(spark, tmp_path):
    empty = [(None, "", "en", "a"), (None, None, "de", "b"), (None, "", None, "c"), (7, "", "en", "a"), (7, None, "fr", "b"), (7, "", "en", "d"),
             (None, " \t\n\x0b\x0c\r", "en", "e"), (8, " ", "en", "f"), (8, " ", "en", "g")]
    # Other white space is a word here.
    rows = empty + [(9, " ", "en", "a"), (10, "\x1c", "en", "a"), (11, "one two three", "en", "a"), (12, "one two three", "de", "b")]
    kept = [tuple(r) for r in C.drop_near_copies(spark, table(spark, rows).repartition(5), str(tmp_path)).collect()]
    assert sorted(kept, key=repr) == sorted(rows[:-1], key=repr)
