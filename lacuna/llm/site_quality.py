"""Quality classifier with hierarchical empirical Bayes over sites.

A document has evidence of its own, the probability that a classifier of its text
gives.  Its host and its path (a part of the host) add what their other documents
show: a path's mean quality is shrunk toward its host's, and a host's toward the
global mean, the more so the fewer documents there are.  How much, is estimated from
how far hosts and paths differ more than their documents' own spread explains.  All
of it is grouped sums; a host or path that holds a third of all rows is summed in
part before each shuffle.

    logit(score) = logit(document) + logit(path posterior) - logit(global mean)

A document's own probability is taken out of its path's and host's sums before they
speak about it, so a lone document is not counted twice and has its parents' mean.

Null and empty texts are scored like any other, from zero measurements.  A very long
text is measured whole; an empty table gives an empty result; scores that reach the
threshold exactly are kept.  A null host
or path is a group of its own.  Without labels of both kinds the documents' evidence
is one half, and every document is kept.  Repeated rows count and are scored each.
Labels without id or verdict are not used; the lowest verdict on an id counts.  Of
`docs` only `doc_id`, `text` and the columns that host and path name are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read, stored
from lacuna.llm.quality_rules import measure

#: Labelled rows that the classifier is fitted on, at most, in the order of a hash of their ids.
LABELLED = 6000
#: Labels of this part of the ids are left for testing.
FOLDS = 5
STEPS = 400
RATE = 0.1
L2 = 1e-3
#: Probabilities stay this far from 0 and 1.
EDGE = 0.005
#: Prior weights, in documents, stay between these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def features(text: str | None) -> list[float]:
    """Shares and sizes of one whole text."""
    n, chars, symbols, dup, repeat, lines, upper, lower = measure(text)
    word, line = max(n, 1), max(lines, 1)
    return [np.log1p(n), chars / word, min(symbols / word, 3), dup / line, repeat / word, upper / max(upper + lower, 1), np.log1p(word / line)]


WIDTH = len(features(""))


@dataclass
class Logistic:
    """Weights over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Logistic:
    """Logistic regression by full-batch Adam; one half everywhere without both kinds."""
    if not len(y) or not 0 < y.mean() < 1:
        return Logistic(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model = Logistic(mean, scale, np.zeros(WIDTH), 0.0)
    m = v = np.zeros(WIDTH + 1)
    for step in range(1, STEPS + 1):
        off = model.probability(x) - y
        g = np.append((x - mean).T @ off / scale / len(y) + L2 * model.weights, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weights, model.bias = model.weights - move[:-1], model.bias - move[-1]
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Logistic:
    """Fit on at most LABELLED rows outside the held-out fold; only their measurements come here."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    measured = F.pandas_udf(lambda texts: pd.Series([features(t) for t in texts]), "array<double>")
    rows = texts.select("y", measured("text").alias("x")).collect()
    return fit(np.array([r.x for r in rows], float).reshape(len(rows), WIDTH), np.array([r.y for r in rows], float))


def evidence(docs: DataFrame, model: Logistic, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the classifier's probability `p`; stored, as the texts are done with."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            p = model.probability(np.array([features(t) for t in texts], float).reshape(len(texts), WIDTH))
            yield pd.Series(np.clip(p, EDGE, 1 - EDGE))

    return stored(docs.select(
        "doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.pandas_udf(score, "double")(F.col("text")).alias("p")), "site-evidence")


def prior_weight(groups: DataFrame, parent_mean: str) -> Column:
    """How many documents a group's parent is worth, by the method of moments.

    groups: n, s, q (number, sum, sum of squares of p) and the parent's mean.  Of the
    squared distance of a group's mean to its parent's, documents' own spread
    explains spread / n; what is left is how groups differ.  The weight is the ratio
    of the two variances.
    """
    inside = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    apart = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent_mean), 2)) - inside * F.count("*")
    between = apart / F.greatest(F.sum("n"), F.lit(1))
    weight = F.when(between > 0, inside / between).otherwise(MOST_WEIGHT)
    return F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums of each (host, path) with its host's, the global mean, and both prior weights.

    What comes to the driver is three numbers.
    """
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = stored(paths, "site-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))
    both = stored(paths.join(hosts.withColumnsRenamed({"n": "host_n", "s": "host_s", "q": "host_q"}), "host"), "site-sums")
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = 0.5 if total is None else float(total)
    host_weight = hosts.withColumn("mean", F.lit(mean)).agg(prior_weight(hosts, "mean")).first()[0]
    path_weight = both.withColumn("mean", F.col("host_s") / F.col("host_n")).agg(prior_weight(both, "mean")).first()[0]
    return both, mean, float(host_weight or MOST_WEIGHT), float(path_weight or MOST_WEIGHT)


def combined(rows: DataFrame) -> DataFrame:
    """Each row with the posterior means that its host and path have without it, and `score`."""
    sums, mean, host_weight, path_weight = posteriors(rows)
    others = lambda s, n, weight, parent: (F.col(s) - F.col("p") + weight * parent) / (F.col(n) - 1 + weight)
    logit = lambda c: F.log(c / (1 - c))
    z = logit(F.col("p")) + logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    return (
        rows.join(sums, ["host", "path"])
        .withColumn("host_posterior", others("host_s", "host_n", host_weight, F.lit(mean)))
        .withColumn("path_posterior", others("s", "n", path_weight, F.col("host_posterior")))
        .withColumn("score", 1 / (1 + F.exp(-z)))
        .select("doc_id", "host", "path", "p", "host_posterior", "path_posterior", "score")
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a host here, and what it has in one language a path."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = combined(evidence(docs, model, F.col("source"), F.col("lang")))
    return scored.select("*", held_out().alias("held_out"), (F.col("score") >= 0.5).alias("kept"))


QUERIES = {"op5_quality_classifier": (op5_quality_classifier, None)}
