"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and from texts whose labels are not
looked at, a mixture in which a known share (the class prior) is toxic.  Its risk is

    prior * risk(toxic as 1) + max(0, risk(unlabelled as 0) - prior * risk(toxic as 0))

where the maximum keeps the estimated risk of the unseen harmless class from going
below zero, which is where an unbounded fit to few positives would drive it.

Features are the distinct words of a text, hashed.  The fit runs with numpy on a
bounded sample of labelled rows; scoring covers every row, inside Spark's tasks.
Labels, language, source and id are never inputs of a score.

Null and empty texts have no words and get the score of the bias alone.  A very long
text is scored whole, in memory in proportion to its length; an empty table gives an
empty result; a score of exactly one half counts as toxic.  Labels
without id or verdict are not used; of several verdicts on one id the toxic one
counts.  Without any toxic label every score is 0.  Repeated rows are scored each.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read
from lacuna.llm.words import ALNUM, word_hashes

#: Sample bounds: rows taken at most, in the order of a hash of their ids.
POSITIVES = 2000
UNLABELLED = 4000
#: Width of the hashed feature space, in bits.
BITS = 18
#: Lengths in bytes of the word beginnings that are features beside the words.
PREFIXES = (4, 5, 6, 8)
FOLDS = 5
EPOCHS = 150
RATE = 0.1
L2 = 1e-4
#: A feature is used when at least so many positive texts have it, and so many standard
#: deviations more of them than the unlabelled share would give.
LEAST_TEXTS = 3
LEAST_DEVIATION = 4.0


def text_features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct hashed words and word beginnings of each whole text."""
    found = []
    for prefix in (None, *PREFIXES):
        hashes, begin = word_hashes(texts, ALNUM, lower=True, prefix=prefix)
        found.append(hashes)
    slots = [(f >> np.uint64(64 - BITS)).astype(np.int32) for f in found]
    return [np.unique(np.concatenate([f[a:b] for f in slots])) for a, b in zip(begin, begin[1:], strict=False)]


@dataclass
class Linear:
    """A weight for each hashed word, and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[f].sum() for f in features], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Linear:
    """Minimise the non-negative risk with logistic loss by full-batch Adam."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Linear(weights, -30.0)
    df, share = (np.bincount(_flat(rows)[0], minlength=1 << BITS) for rows in (positive, unlabelled))
    share = share / len(unlabelled)
    spread = np.sqrt(len(positive) * share * (1 - share) + 1)
    known = np.flatnonzero((df >= LEAST_TEXTS) & (df - len(positive) * share >= LEAST_DEVIATION * spread))
    place = np.full(1 << BITS, -1)
    place[known] = np.arange(len(known))
    data = []
    for rows in (positive, unlabelled):
        cols, row = _flat(rows)
        keep = place[cols] >= 0
        data.append((place[cols[keep]], row[keep], len(rows)))
    w, b = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)

    def logits(part):
        cols, row, n = part
        return np.bincount(row, w[cols], n) + b

    def gradient(part, slope):
        cols, row, n = part
        return np.append(np.bincount(cols, slope[row], len(known)), slope.sum()) / n

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, EPOCHS + 1):
        zp, zu = logits(data[0]), logits(data[1])
        harmless = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_zero = gradient(data[1], sigmoid(zu)) - prior * gradient(data[0], sigmoid(zp))
        as_one = prior * gradient(data[0], sigmoid(zp) - 1)
        # Below zero the harmless part is overfitted: only that part is stepped back.
        g = as_one + as_zero if harmless >= 0 else -as_zero
        g[:-1] += L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[known] = w
    return Linear(weights, float(b))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; a null id has no labels and is not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Linear:
    """Fit on at most POSITIVES toxic rows and UNLABELLED rows of any label, not held out.

    The class prior is the toxic share of all labels outside the held-out fold.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    pick = lambda rows, n, role: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(role).alias("role"))
    sample = pick(known.where("toxic = 1"), POSITIVES, 1).unionAll(pick(known, UNLABELLED, 0))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "role").agg(F.max("text").alias("text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"role": b["role"], "f": [f.tobytes() for f in text_features(b["text"].tolist())]})

    rows = texts.select("role", "text").mapInPandas(featured, "role int, f binary").collect()
    by_role = {role: [np.frombuffer(r.f, np.int32) for r in rows if r.role == role] for role in (0, 1)}
    return fit(by_role[1], by_role[0], float(prior))


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """The documents with `score`, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.scores(text_features(texts.iloc[at : at + 128].tolist())) for at in range(0, len(texts), 128)]
            yield pd.Series(np.concatenate([*parts, np.zeros(0)]))

    return docs.withColumn("score", F.pandas_udf(score, "double")(F.col("text")))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic; columns as they came."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    kept = scored(rows, learn(docs, labels)).where("score < 0.5")
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = scored(docs.select("doc_id", "text"), learn(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": (op8_toxicity, None)}
