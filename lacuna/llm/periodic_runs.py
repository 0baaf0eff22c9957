"""Periodic runs: stretches of words that repeat with a period, as long as they do.

A run of period q and length n is a pair of equal stretches of n - q words, q words
apart, that cannot be extended to the left nor to the right: a maximal pair.  A pair
is found in the tree of LCP intervals of the text's suffixes, bottom up.  Positions
of different children of an interval differ in the word to the right; positions with
different left words differ to the left.  With the interval's depth as the length of
the stretch, every such pair whose distance is at most the depth is a run, with no
extension needed.  A pair with an occurrence between has a multiple of the period,
so that each position has to look at its neighbours in the interval only; of pairs
for the same stretch, the smallest distance is the period.

A run of at least SHORTEST words has a stretch of half as many, so only intervals at
least that deep are built, and texts where no stretch of that length comes twice have
no tree at all.  Intervals whose positions all have the same left word have no pairs
and are passed over; that is nearly all of a periodic text.

Null, empty and white-space texts have no words and no runs, and collapse to the empty
text.  Very long texts take memory in proportion to their words.  Equal 64-bit hashes
of words of one text count as equal words.  There are no ties: runs are a set, given by
start, then period.  Repeated rows are handled each; an empty table gives an empty table.
Only `text` is read; columns named like those added are replaced, others are carried.
"""

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lacuna.llm.common import read
from lacuna.llm.words import SPACE, mix, window_hashes, word_spans

#: A run has at least so many words, and at least twice its period.
SHORTEST = 12
DEPTH = SHORTEST // 2
#: Bytes of texts handled at once; a longer text is handled alone.
SLICE_BYTES = 2_000_000

_WORD = re.compile("[^ \t-\r]+")
_RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def suffix_order(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the order of their suffixes, and the words that each shares with the one before.

    words: ids, equal only within a text; end: where the text of each position ends.
    Ranks by prefixes of 1, 2, 4, ... words; only positions that still share a rank are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.ones(n, bool)
    first[1:] = words[order[1:]] != words[order[:-1]]
    ranks = [np.empty(n, np.int32)]
    slot = np.arange(n)
    ranks[0][order] = np.maximum.accumulate(np.where(first, slot, 0))
    shared, width = np.zeros(n, np.int64), 1
    while not first.all():
        # Slots of groups with more than one position.
        open_ = np.flatnonzero(~first | np.append(~first[1:], False))
        at, rank = order[open_], ranks[-1]
        beyond = at + width
        inside = beyond < end[at]
        key = rank[at].astype(np.int64) * (n + 1) + np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[open_] = at
        new = np.append(True, key[1:] != key[:-1])
        cut = open_[new & ~first[open_]]  # neighbours parted here share `width` words and as many as their rests do
        a, b, more = order[cut - 1] + width, order[cut] + width, np.full(len(cut), width)
        for old, step in zip(ranks[::-1], width // 2 ** np.arange(len(ranks)), strict=True):
            same = (a < end[order[cut - 1]]) & (b < end[order[cut]])
            same[same] = old[a[same]] == old[b[same]]
            more += same * step
            a, b = a + same * step, b + same * step
        shared[cut] = more
        first[cut] = True
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        ranks.append(rank)
        width *= 2
    return order, shared


def maximal_pairs(places: list[int], shared: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, a, b) of neighbouring positions of an interval that are a maximal pair.

    places: positions in suffix order; shared: words shared with the one before; left:
    the word before each.  An interval's node has its sorted positions, and the class
    of their left words if they have one in common.
    """
    word = dict(zip(places, left, strict=True))
    mixed = object()  # the class of positions with different left words

    def joined(depth: int, node: tuple, child: tuple) -> tuple:
        (big, of_big), (small, of_small) = (node, child) if len(node[0]) >= len(child[0]) else (child, node)
        same = of_big == of_small and of_big is not mixed
        if not same:
            for x in small:
                i = bisect_left(big, x)
                for y in big[max(i - 1, 0) : i + 1]:
                    if abs(x - y) <= depth and word[x] != word[y]:
                        found.append((depth, min(x, y), max(x, y)))
        for x in small:
            insort(big, x)
        return big, of_big if same else mixed

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, tuple]] = []
    for i, depth in enumerate([*shared[1:], 0]):
        node = ([places[i]], left[i])
        while stack and stack[-1][0] > depth:
            above, other = stack.pop()
            node = joined(above, other, node)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(depth, stack[-1][1], node))
        elif depth:
            stack.append((depth, node))
    return found


def runs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (text, start, length, period) of all texts, sorted; and the words that they repeat, as a mask.

    hashes: of the words of all texts; first: where each text's begin, and the end.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    drop = np.zeros(len(hashes), bool)
    none = np.zeros((0, 4), np.int64)
    # Texts with a window of DEPTH words that comes twice.
    windows = window_hashes(hashes, DEPTH) if len(hashes) >= DEPTH else hashes[:0]
    inside = text[: len(windows)] == text[DEPTH - 1 :][: len(windows)]
    own = mix(text.astype(np.uint64) + np.uint64(1))
    keys = windows[inside] ^ own[: len(windows)][inside]
    by = np.argsort(keys)
    twice = keys[by][1:] == keys[by][:-1]
    some = np.unique(text[: len(windows)][inside][by[1:][twice]])
    if not len(some):
        return none, drop
    # Their words alone, one text behind another.
    hit = np.zeros(len(count), bool)
    hit[some] = True
    back = np.flatnonzero(hit[text])
    ends = np.cumsum(count[some])
    end = np.repeat(ends, count[some])
    _, words = np.unique(hashes[back] ^ own[back], return_inverse=True)
    order, shared = suffix_order(words, end)
    left = np.append(-1, words[:-1])
    left[ends[:-1]] = -1
    # Stretches of suffixes that share DEPTH words, and in them different left words.
    deep = shared >= DEPTH
    group = np.cumsum(~deep) - 1
    differs = np.append(False, (left[order[1:]] != left[order[:-1]]) & deep[1:])
    diverse = np.zeros(group[-1] + 1, bool)
    diverse[group[differs]] = True
    slots = np.flatnonzero(diverse[group])
    cuts = np.append(np.flatnonzero(np.diff(group[slots], prepend=-1)), len(slots))
    pairs = []
    places, depths, lefts = order[slots], np.where(deep[slots], shared[slots], 0), left[order[slots]]
    two = cuts[:-1][np.diff(cuts) == 2]  # two positions are a tree by themselves
    a, b = np.minimum(places[two], places[two + 1]), np.maximum(places[two], places[two + 1])
    pairs.append(np.stack([depths[two + 1], a, b], 1))
    more = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x > 2]
    for x, y in more:
        pairs.append(np.array(maximal_pairs(places[x:y].tolist(), depths[x:y].tolist(), lefts[x:y].tolist()), np.int64).reshape(-1, 3))
    depth, a, b = np.concatenate(pairs).T
    period = b - a
    ok = (depth >= period) & (depth + period >= SHORTEST)
    a, length, period = a[ok], (depth + period)[ok], period[ok]
    by = np.lexsort((period, length, a))
    a, length, period = a[by], length[by], period[by]
    ok = np.append(True, (a[1:] != a[:-1]) | (length[1:] != length[:-1]))[: len(a)]
    a, length, period = back[a[ok]], length[ok], period[ok]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, a + period, 1)
    np.add.at(edge, a + length, -1)
    runs = np.stack([text[a], a - first[text[a]], length, period], 1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))], np.cumsum(edge[:-1]) > 0


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def with_runs(docs: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add the runs of each text, and the text without the words that runs repeat.

    runs: start (number of the word), length and period, by start, then period.
    collapsed: the words that stand in no run, or in its first period, with a space between.
    """
    kept = docs.drop(runs, collapsed)
    at_text = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            for a, b in _slices(texts):
                _, _, _, hashes, first = word_spans(texts[a:b], SPACE, lower=False)
                found, drop = runs_of(hashes, first)
                owner = np.searchsorted(found[:, 0], np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(owner), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(found[:, i])) for i in (1, 2, 3)], ["start", "length", "period"]))
                short = []
                for i, t in enumerate(texts[a:b]):
                    words = _WORD.findall(t) if t else []
                    if owner[i + 1] > owner[i]:
                        words = [w for w, gone in zip(words, drop[first[i] : first[i + 1]].tolist(), strict=True) if not gone]
                    short.append(" ".join(words))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(short, pa.string())], [*part.schema.names, runs, collapsed])

    schema = StructType([*kept.schema.fields, StructField(runs, ArrayType(_RUN)), StructField(collapsed, StringType())])
    return kept.mapInArrow(run, schema)


def all_runs(docs: DataFrame) -> DataFrame:
    """A row per run: doc_id, start, length, period."""
    return with_runs(docs.select("doc_id", "text")).select("doc_id", F.inline("runs"))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """Texts of a tenth of ids with their tail made periodic, as the contract of the query says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(w, lambda _, i: F.get(w, at(i))), " ")

    # A projection inside the branch: only these rows are split.
    found = F.filter(F.transform(F.array(words), planted), lambda t: t != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(F.get(found, F.lit(0)), text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    rows = with_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op12_periodic_runs": (op12_periodic_runs, None)}
