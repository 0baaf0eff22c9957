"""N-gram Jaccard join over a token-group matrix.

Two documents link when their sets of word shingles have a Jaccard similarity of at
least `PERCENT` hundredths.  A result is a class per document: the smallest doc_id
that links reach.

1. Documents with equal sets are one class, known by the digest of its set.
2. The probing tokens of a class are its rarest shingles, so many that two similar
   sets must share one (n - ceil(n * PERCENT / 100) + 1 of n, in one order for all).
   The order puts shingles that many documents share last; which ones those are is
   counted first, over all documents, from the shingles that a task met more than once.
3. Groups: classes that share a token are compared with the leader of that token,
   and links make groups.  A family of near copies thus becomes one group at the
   cost of a comparison per token, not per pair.
4. The token-group matrix holds the union of the groups' tokens.  A class can only
   link with a member of a group whose union holds one of its probing tokens: that
   bounds the overlap.  Tokens that occur in one group alone open nothing.  For the
   others, classes of different groups are compared, if their sizes and what is left
   of both from the token on allow a link.
5. A comparison first looks at parity sketches, whose distance is a lower bound of
   the sets' difference; only pairs that pass are compared shingle by shingle.

Nothing is left to chance but equality of 64-bit hashes: all links are found.

Null and empty texts have no set and link with nothing.  A very long text's set
takes memory in proportion to its words; an empty table gives an empty result; of
several ids that could name a class the smallest does.  A document of fewer words
than a shingle has its whole sequence as its one shingle.  A null id never names a
class unless all ids in it are null.  Repeated rows get a result each.  Only `doc_id`
and `text` are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import read, stored, whole_text
from lacuna.llm.links import components
from lacuna.llm.words import SPACE, mix, window_hashes, word_hashes

WIDTH = 5
PERCENT = 80
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Least bits of a parity sketch; it has about as many as its set has tokens.
SKETCH = 256
#: Texts handled at once in a task.
SLICE = 256
#: A shingle is common from so many documents on, as far as the partial counts show.
COMMON = 8
#: Partial counts below this stay in their task.
PARTIAL = 2
#: Common shingles told to every task, the most frequent first: 16 bytes each.
MAX_COMMON = 1_000_000


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    hashes, begin = word_hashes(texts, SPACE, lower=True)
    return [np.unique(window_hashes(hashes[a:b], width)) for a, b in zip(begin, begin[1:], strict=False)]


def digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set, 0 for the empty one."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = mix(mix(tokens) + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of how many tokens fall on each bit; the number of bits is a power of two."""
    bits = max(SKETCH, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else SKETCH
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens two sets do not share, from their sketches.

    The longer sketch is folded to the length of the other: the parity of a bit of
    half as many is that of the two bits it takes over.
    """
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for half in (4 * n for n in _halves(len(a), len(b))):
        x = (x >> half) ^ (x & ((1 << half) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _halves(longer: int, shorter: int) -> list[int]:
    """Byte lengths from the longer down to twice the shorter."""
    out = []
    while longer > shorter:
        out.append(longer)
        longer //= 2
    return out


def probing(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which similar sets share one: the rarest, by (count if common, hash)."""
    n = len(tokens)
    many = n + (-n * percent) // 100 + 1
    if not len(common):
        return tokens[:many]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    rank = np.where(common[at] == tokens, counts[at], 0)
    return tokens[np.argsort(rank, kind="stable")[:many]]


def _by_text(docs: DataFrame, schema: str, rows) -> DataFrame:
    """rows(texts, other columns) for small slices of each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                yield rows(b.iloc[at : at + SLICE])

    return docs.mapInPandas(run, schema)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles in many documents, at most MAX_COMMON, sorted by hash.

    Each task counts its own documents and passes on what it met PARTIAL times.  The
    result orders the probing tokens; any order gives the same links, a good one
    keeps tokens' lists short.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for at in range(0, len(b), SLICE):
                new = shingle_sets(b["text"].iloc[at : at + SLICE].tolist())
                held, size = held + new, size + sum(map(len, new))
                if size > 4_000_000:
                    yield table(held)
                    held, size = [], 0
        yield table(held)

    def table(sets: list[np.ndarray]) -> pd.DataFrame:
        tokens, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        keep = n >= PARTIAL
        return pd.DataFrame({"token": tokens[keep].view(np.int64), "n": n[keep]})

    partial = docs.select("text").mapInPandas(count, "token long, n long")
    totals = partial.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = totals.orderBy(F.desc("n"), "token").limit(MAX_COMMON).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy(np.int64)[order]


def members(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set digest `key`, set size `n` and sketch of every row."""

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for at in range(0, len(texts), SLICE):
                found += [(digest(s), len(s), sketch(s)) for s in shingle_sets(texts.iloc[at : at + SLICE].tolist())]
            yield pd.DataFrame(found, columns=["key", "n", "sketch"])

    measured = F.pandas_udf(measure, "key long, n int, sketch binary")
    named = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), measured("text").alias("m"))
    return named.select("doc_id", "text_key", "m.*")


def probes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """token, key, n, at: a row for each probing token of each class, with its place in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MAX_COMMON entries

    def rows(b: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(b["text"].tolist())
        _, first = np.unique([digest(s) for s in sets], return_index=True)  # copies side by side count once
        sets = [sets[i] for i in first]
        tokens = [probing(s, *shared.value, percent) for s in sets]
        sizes = [len(t) for t in tokens]
        return pd.DataFrame({
            "token": np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64),
            "key": np.repeat(np.array([digest(s) for s in sets], np.int64), sizes), "n": np.repeat([len(s) for s in sets], sizes),
            "at": np.concatenate([*map(np.arange, sizes), np.zeros(0, int)])})

    return _by_text(docs.select("text"), "token long, key long, n int, at int", rows)


def lists(probed: DataFrame) -> DataFrame:
    """Tokens of more than one class: token, key, n, at, and the same of the list's leader.

    The leader is the class with the fewest rarer tokens before this one: of a family
    of near copies the original, or what is nearest to it.
    """
    order = Window.partitionBy("token").orderBy("at", "n", "key")
    leader = [F.first(c).over(order).alias(f"leader_{c}") for c in ("key", "n", "at")]
    rows = probed.select("*", *leader, F.lead("key").over(order).alias("next"), F.lag("key").over(order).alias("last"))
    # Copies of a class in one list stand side by side.
    fresh = F.col("last").isNull() | (F.col("last") != F.col("key"))
    alone = F.col("last").isNull() & F.col("next").isNull()
    return rows.where(fresh & ~alone).drop("last", "next")


def _room(x: str, y: str, percent: int) -> str:
    """Whether two classes can link whose first common token is the row's.

    Before it they share nothing, so what they share is at most what is left from it
    on.  Every link has a row, that of its first common token, for which this holds.
    """
    left = f"least({x}n - {x}at, {y}n - {y}at)"
    return f"{100 + percent} * {left} >= {percent} * ({x}n + {y}n) AND 100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)"


def _could_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([least_apart(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    apart = F.pandas_udf(bound, "long")("sketch_a", "sketch_b")
    # Of x + y tokens in all, a link has at most (100 - percent) / (100 + percent) not in both.
    room = (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return both.withColumn("apart", apart).where(F.col("apart") * (100 + percent) <= room).select("a", "b")


def candidate_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key and tokens of the classes asked for, made again from a text of each.

    Texts are fetched by id; an id may stand for several texts, or be null for many,
    so what comes is matched by digest again.
    """
    asked = keys.join(classes.select("key", "doc_id"), "key")
    ids = asked.select(F.col("doc_id").alias("id")).distinct()

    def sets(b: pd.DataFrame) -> pd.DataFrame:
        found = shingle_sets(b["text"].tolist())
        return pd.DataFrame({"key": [digest(s) for s in found], "tokens": [s.view(np.int64) for s in found]})

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    made = _by_text(texts, "key long, tokens array<long>", sets).groupBy("key").agg(F.first("tokens").alias("tokens"))
    return made.join(keys, "key", "left_semi")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; a class in many pairs is split by adaptive execution."""
    near = stored(_could_link(pairs, classes, percent), "candidate-pairs")
    keys = stored(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "candidate-keys")
    found = stored(candidate_sets(keys, classes, docs), "candidate-sets")
    side = lambda c: found.select(F.col("key").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def class_links(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key and `group` of every class that links with another; equal groups are connected."""
    classes = stored(rows.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")), "classes")
    listed = stored(lists(probes(docs, common_shingles(docs), percent)), "token-lists")
    led = listed.where("key != leader_key").where(_room("", "leader_", percent)).select(*_ordered("leader_key", "key")).distinct()
    led = stored(led, "leader-pairs")
    first = stored(verified(led, classes, docs, percent), "leader-links")
    groups = components(first)
    # The matrix: which groups have which token.
    grouped = listed.select("token", "key", "n", "at").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    grouped = stored(grouped, "token-groups")
    opened = grouped.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("token")
    still = stored(grouped.join(opened, "token", "left_semi"), "open-tokens")
    x, y = still.alias("x"), still.alias("y")
    pairs = (
        x.join(y, F.expr(f"x.token = y.token AND x.group < y.group AND {_room('x.', 'y.', percent)}"))
        .select(*_ordered("x.key", "y.key")).distinct().join(led, ["a", "b"], "left_anti")
    )
    second = verified(pairs, classes, docs, percent)
    return components(stored(first.unionAll(second), "links"))


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and `kept` of every row.

    Of each class the row with the smallest id (then text) is kept, and every row
    without a set; rows that are the same in id and text are so in this too.
    """
    rows = stored(members(docs), "shingle-members")
    groups = class_links(docs, rows, percent)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    least = rows.where("n > 0").groupBy("key").agg(F.min(row).alias("least"))
    of_class = stored(least.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key")), "class-least")
    of_group = of_class.groupBy("group").agg(F.min("least").alias("first"))
    named = of_class.join(of_group, "group").select("key", "first")
    size = F.col("n").cast("long").alias("n_shingles")
    linked = rows.where("n > 0").join(named, "key").select(
        "doc_id", "text_key", size, F.col("first.doc_id").alias("component_id"), (row == F.col("first")).alias("kept"))
    alone = rows.where("n = 0").select("doc_id", "text_key", size, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionAll(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each class, and all without a set; columns as they came.

    Rows are joined to their verdicts by id and text.  Rows with words that are the
    same in both are merged in their tasks first; rows without any pass as they are.
    """
    worded = F.ltrim(whole_text(), F.lit(SPACES)) != ""
    verdict = similar_documents(docs, percent).where("kept AND n_shingles > 0").select("doc_id", "text_key").distinct()
    rows = docs.where(worded).select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("text_key"))
    merged = rows.groupBy("id", "text_key").agg(F.first("doc").alias("doc"))
    v = verdict.withColumnsRenamed({"doc_id": "v_id", "text_key": "v_key"})
    kept = merged.join(v, F.col("id").eqNullSafe(F.col("v_id")) & (F.col("text_key") == F.col("v_key")), "left_semi")
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns)).unionAll(docs.where(~worded))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_ngram_jaccard_join": (op4_ngram_jaccard_join, None)}
