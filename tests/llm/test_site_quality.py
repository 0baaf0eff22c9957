import numpy as np
import pytest
from odd_rows import ROWS, clashing, folder, table

from lacuna.llm import site_quality as Q

LABELS = "doc_id long, quality int, toxic int"


def save(spark, tmp_path, docs, labels):
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return folder(docs, tmp_path)


def plain(rows):
    """Scores of (host, path, p) by the formulas, one row at a time."""
    def weight(groups, parent):
        n, s, q = (np.array([g[k] for g in groups.values()], float) for k in range(3))
        inside = (q - s * s / n).sum() / max((n - 1).sum(), 1)
        between = ((n * (s / n - np.array([parent(k) for k in groups])) ** 2).sum() - inside * len(n)) / max(n.sum(), 1)
        return min(max(inside / between if between > 0 else Q.MOST_WEIGHT, Q.LEAST_WEIGHT), Q.MOST_WEIGHT)

    def sums(key):
        out = {}
        for r in rows:
            g = out.setdefault(key(r), [0, 0.0, 0.0])
            g[0] += 1; g[1] += r[2]; g[2] += r[2] ** 2  # noqa: E702
        return out

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    mean = sum(r[2] for r in rows) / len(rows)
    wh, wp = weight(hosts, lambda k: mean), weight(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0])
    logit = lambda x: np.log(x / (1 - x))
    out = []
    for h, p, x in rows:
        host = (hosts[h][1] - x + wh * mean) / (hosts[h][0] - 1 + wh)
        path = (paths[h, p][1] - x + wp * host) / (paths[h, p][0] - 1 + wp)
        out.append(1 / (1 + np.exp(-(logit(x) + logit(path) - logit(mean)))))
    return out


def test_scores_follow_the_formulas(spark):
    rng = np.random.default_rng(1)
    level = {h: rng.uniform(0.2, 0.95) for h in range(6)}
    rows = [(f"h{h}", f"p{rng.integers(4)}", float(np.clip(rng.normal(level[h], 0.15), 0.01, 0.99))) for h in level for _ in range(rng.integers(1, 80))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = {r.doc_id: r.score for r in Q.combined(df).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], plain(rows))


def test_sparse_sites_stay_near_the_global_mean(spark):
    rows = [("big", "a", 0.2)] * 200 + [("fine", "a", 0.9)] * 200 + [("lone", "a", 0.2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = {(r.host, round(r.path_posterior, 6)) for r in Q.combined(df).collect()}
    by = dict(got)
    assert by["big"] < 0.25 and by["fine"] > 0.85 and abs(by["lone"] - sum(r[2] for r in rows) / len(rows)) < 1e-3


def test_odd_rows(spark, tmp_path):
    rows = Q.op5_quality_classifier(spark, save(spark, tmp_path, clashing(table(spark)), [(1, 1, 0), (None, 0, 0), (2, None, 0)])).collect()
    assert len(rows) == len(ROWS) and all(r.kept and 0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark, tmp_path):
    assert Q.op5_quality_classifier(spark, save(spark, tmp_path, table(spark, []), [])).collect() == []


@pytest.mark.parametrize("size", ["0.1"])
def test_held_out_accuracy(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = Q.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert sum(not r.kept for r in rows if r.quality == 1) <= 0.01 * len(rows)
