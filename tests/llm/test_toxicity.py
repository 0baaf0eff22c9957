import zlib

import numpy as np
import pytest
from odd_rows import ROWS, clashing, folder, table

from lacuna.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def save(spark, tmp_path, docs, labels):
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return folder(docs, tmp_path)


def test_odd_rows_without_toxic_labels(spark, tmp_path):
    rows = T.op8_toxicity(spark, save(spark, tmp_path, clashing(table(spark)), [(1, 1, 0), (None, 1, 1), (2, 0, None)])).collect()
    assert len(rows) == len(ROWS) and {r.predicted for r in rows} == {0}
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_empty_tables(spark, tmp_path):
    assert T.op8_toxicity(spark, save(spark, tmp_path, table(spark, []), [])).collect() == []


def test_learns_from_the_other_folds_only(spark, tmp_path):
    toxic = lambda i: i % 3 == 0
    docs = [(i, f"plain text number{i} of some words " + ("vile filth " if toxic(i) else "kind remark "), "en", "a") for i in range(300)]
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    # Held-out labels are all wrong; they must not matter.
    labels = [(i, 1, int(toxic(i)) if i in set(train) else 1 - int(toxic(i))) for i in range(300)]
    rows = T.op8_toxicity(spark, save(spark, tmp_path, table(spark, docs), labels)).collect()
    assert all(r.predicted == int(toxic(r.doc_id)) for r in rows)


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 2000, 30)) for _ in range(400)]
    for r in rows[:80]:
        r[0] = 2001
    model = T.fit(rows[:60], rows, 0.2)
    # The eighty are found although twenty of them are only among the unlabelled.
    scores = model.scores(rows)
    assert scores[:80].min() > 0.5 > scores[80:].max()


def test_features_are_the_same_in_any_batch():
    texts = ["Some WORDS here", "", None, "some words here", "ünïcödé wörds " * 50]
    together = T.text_features(texts)
    assert all((a == T.text_features([t])[0]).all() for a, t in zip(together, texts, strict=True))
    assert (together[0] == together[3]).all() and len(together[1]) == 0


@pytest.mark.parametrize("size", ["0.1"])
def test_held_out_accuracy(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = T.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
