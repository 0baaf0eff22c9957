"""Top hits from postings kept in blocks, of which only those that can matter are read.

A block holds the postings of one term in a stretch of a document's pages, and beside
them what bounds their share of a score: the largest term frequency, the shortest
passage, whether one defines something.  Blocks of different terms cover the same
stretches, so a stretch's bound for a question is the sum over its terms, and needs no
postings.  The stretches with the highest bounds are scored first; a stretch whose
bound stays below the k-th score found there is never read.

BM25's weights come from the whole index at the time of asking, so blocks stay as they
were written when others are added or removed.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import tokens as T
from lacuna.operators import search
from lacuna.session import materialise

PAGES_PER_BLOCK = 32
#: Stretches per question that are scored before the rest is judged by its bounds.
PROBED = 2
#: Bounds are sums of rounded numbers; one that misses by less than this counts as reached.
SLACK = 1e-6

#: Terms that a task holds while it waits for the end of a stretch, and rows that it gives back at once.
HELD_TERMS, BLOCK_ROWS = 1 << 18, 10_000

STRETCH = ["document_id", "version", "block"]
_STRETCH = ["document_id", "block"]
_SORTED = [*_STRETCH, "page_number", "chunk_ordinal", "readable", "defines", "length"]
_POST = ["page_number", "chunk_ordinal", "tf", "length", "defines"]


@dataclass
class Found:
    """hits as search.top_hits gives them, and how much of the index they took."""

    hits: DataFrame
    read: DataFrame  # stretches scored: query_id, STRETCH
    bounds: DataFrame  # all stretches with an asked-for term: query_id, STRETCH, bound
    asked: DataFrame


def block_postings(tokens: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Postings of search.tokenised chunks by document, stretch of pages and term.

    Placeholders of unreadable pages count in `df` and `terms`, the sum of all term
    frequencies, and have no postings.  The one exchange deals out chunks by stretch, in
    whose order their terms are counted, some stretches at a time; a stretch is bounded,
    a document is not.  Chunks of one key, length and kind count as one.
    """
    block = F.floor(F.col("page_number") / F.lit(pages_per_block)).cast("long")
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    # Chunks without terms go along: to ask for them here would compute all terms twice.
    dealt = tokens.where(F.col("document_id").isNotNull()).withColumn("block", block).select(*_SORTED, "terms")
    post = ",".join(f"{c}:{kinds.get(c, 'bigint')}" for c in _POST)
    return dealt.repartition("document_id", "block").sortWithinPartitions(*_SORTED).mapInArrow(
        _counted, f"document_id {kinds['document_id']}, block long, term string, df long, max_tf long, min_length int, defines boolean, terms long, posts array<struct<{post}>>")


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values; null is a value."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()


def _begins(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Which rows have other values than the row before."""
    begin = np.zeros(rows.num_rows, bool)
    begin[:1] = True
    for c in columns:
        codes = _codes(rows.column(c))
        begin[1:] |= codes[1:] != codes[:-1]
    return begin


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows in the order of _SORTED; a stretch is counted when all its rows are there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(h.column("terms").flatten()) for h in held) >= HELD_TERMS:
            rows = pa.concat_batches(held)
            whole = int(np.flatnonzero(_begins(rows, _STRETCH))[-1])
            yield from _blocks_of(rows.slice(0, whole))
            held = [rows.slice(whole)]
    if held:
        yield from _blocks_of(pa.concat_batches(held))


def _blocks_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy()
    if not sizes.any():
        return
    stretch_begins = _begins(rows, _STRETCH)
    chunk_begins = stretch_begins | _begins(rows, _SORTED[len(_STRETCH):])
    chunk, first_row = np.cumsum(chunk_begins) - 1, np.flatnonzero(chunk_begins)
    stretch, stretch_row = (np.cumsum(stretch_begins) - 1)[first_row], np.flatnonzero(stretch_begins)
    coded = pc.dictionary_encode(rows.column("terms").flatten())
    n_terms = np.int64(len(coded.dictionary))
    # One post per chunk and term, then in the order of stretch and term.
    post, tf = np.unique(np.repeat(chunk, sizes) * n_terms + coded.indices.to_numpy(), return_counts=True)
    of, term = post // n_terms, post % n_terms
    key = stretch[of] * n_terms + term
    order = np.argsort(key, kind="stable")
    of, tf, key = of[order], tf[order], key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row = first_row[of]
    readable = pc.fill_null(rows.column("readable"), False).to_numpy(zero_copy_only=False)[row]
    defines = rows.column("defines").take(pa.array(row))
    known = readable & defines.is_valid().to_numpy(zero_copy_only=False)
    true = readable & pc.fill_null(defines, False).to_numpy(zero_copy_only=False)
    length = pc.fill_null(rows.column("length"), 0).to_numpy()[row]
    any_of = np.logical_or.reduceat
    none, unknown = ~any_of(readable, first), ~any_of(known, first)
    shown = np.flatnonzero(readable)
    ends = np.append(0, np.cumsum(np.add.reduceat(readable.astype(np.int32), first, dtype=np.int32))).astype(np.int32)
    at = pa.array(row[shown])
    posts = pa.StructArray.from_arrays(
        [rows.column("page_number").take(at), rows.column("chunk_ordinal").take(at), pa.array(tf[shown]), pa.array(length[shown]), defines.take(pa.array(shown))], _POST)
    in_row = pa.array(stretch_row[key[first] // n_terms])
    blocks = pa.RecordBatch.from_arrays(
        [rows.column("document_id").take(in_row), rows.column("block").take(in_row), coded.dictionary.take(pa.array(key[first] % n_terms)),
         pa.array(np.diff(np.append(first, len(key)))), pa.array(np.maximum.reduceat(np.where(readable, tf, 0), first), mask=none),
         pa.array(np.minimum.reduceat(np.where(readable, length, np.iinfo(np.int32).max), first).astype(np.int32), mask=none),
         pa.array(any_of(true, first), mask=unknown), pa.array(np.add.reduceat(tf, first)), pa.ListArray.from_arrays(pa.array(ends), posts)],
        ["document_id", "block", "term", "df", "max_tf", "min_length", "defines", "terms", "posts"])
    for at_row in range(0, blocks.num_rows, BLOCK_ROWS):
        yield blocks.slice(at_row, BLOCK_ROWS)


def document_totals(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks and terms per document, as sums that can be added up over segments.

    Terms come from the numbers of block_postings, so the text is tokenised once.
    """
    n = chunks.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    terms = blocks.groupBy("document_id").agg(F.sum("terms").alias("terms"))
    return n.join(terms, "document_id", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))


def merged(blocks: DataFrame) -> DataFrame:
    """Blocks of several segments as one block per document, stretch and term."""
    columns = ["document_id", "block", "term", "df", "max_tf", "min_length", "defines", "posts"]
    shared = shared_stretches(blocks).withColumnsRenamed({"document_id": "_document", "block": "_block"})
    same = F.col("document_id").eqNullSafe(F.col("_document")) & F.col("block").eqNullSafe(F.col("_block"))
    together = blocks.join(shared, same, "left_semi").groupBy("document_id", "block", "term").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"),
        F.max("defines").alias("defines"), F.flatten(F.collect_list("posts")).alias("posts"))
    return blocks.join(shared, same, "left_anti").select(columns).unionByName(together.select(columns))


def shared_stretches(blocks: DataFrame) -> DataFrame:
    """Stretches of a document with blocks of several versions; the others need no merging, and are not shuffled for it.

    They come from numbers alone, without the postings, and are stored.
    """
    versions = blocks.groupBy("document_id", "block").agg(F.min("version").alias("a"), F.max("version").alias("b"))
    return materialise(versions.where(F.col("a") < F.col("b")).select("document_id", "block"))


def _share(tf: Column, length: Column, defines: Column) -> Column:
    boost = F.when(F.col("wants") & defines, V.DEFINITION_BOOST).otherwise(1.0)
    return search.contribution(F.col("weight"), F.col("idf"), tf, length, F.col("avg_len")) * boost


def _weights(headers: DataFrame, totals: DataFrame, asked: DataFrame, questions: DataFrame) -> DataFrame:
    """Each question's terms with multiplicity, idf and mean length, over all live segments."""
    sums = totals.groupBy("document_id").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms"))
    frequency = headers.groupBy("document_id", "term").agg(F.sum("df").alias("df")).join(sums, "document_id")
    wanted = questions.select("query_id", T.wants_definition(F.col("question")).alias("wants"))
    return (
        asked.groupBy("query_id", "document_id", "term").agg(F.count(F.lit(1)).alias("weight"))
        .join(frequency, ["document_id", "term"]).join(wanted, "query_id")
        .select("query_id", "document_id", "term", "weight", "wants", search.idf(F.col("df"), F.col("n")).alias("idf"), (F.col("terms") / F.col("n")).alias("avg_len"))
    )


def _scored(blocks: DataFrame, weights: DataFrame, stretches: DataFrame) -> DataFrame:
    """Scores of all passages of some (question, stretch), like search.scores."""
    wanted = stretches.join(weights, ["query_id", "document_id"])
    posts = blocks.where(F.size("posts") > 0).select(*STRETCH, "term", "posts").join(wanted, [*STRETCH, "term"])
    # Shares are worked out inside the block's row; only chunk keys and numbers are exploded.
    shares = F.transform("posts", lambda p: F.struct(
        p["page_number"].alias("page_number"), p["chunk_ordinal"].alias("chunk_ordinal"), _share(p["tf"], p["length"], p["defines"]).alias("share")))
    flat = posts.select("query_id", "document_id", "idf", F.explode(shares).alias("p")).select("query_id", "document_id", "idf", "p.*")
    return flat.groupBy(*search.CHUNK, "query_id").agg(
        F.sum("share").alias("score"), F.count(F.lit(1)).alias("matched"), F.count_if(F.col("idf") >= V.DISTINCTIVE_IDF).alias("distinctive"),
    ).where(F.col("score") > 0)


def top_hits(blocks: DataFrame, totals: DataFrame, questions: DataFrame, k: int = V.TOP_K, probed: int = PROBED) -> Found:
    """Best k passages per question, as search.top_hits of search.scores over all chunks.

    blocks: block_postings with a `version`; totals: document_totals.  Headers of
    asked-for terms, bounds and first scores are small next to the postings and stored.
    """
    asked = materialise(search.query_terms(questions))
    terms = materialise(asked.select("document_id", "term").distinct())
    headers = materialise(blocks.drop("posts").join(terms, ["document_id", "term"], "left_semi"))
    # Before they meet questions, blocks of other terms are dropped where they are read.
    blocks = blocks.join(terms, ["document_id", "term"], "left_semi")
    weights = materialise(_weights(headers, totals, asked, questions))
    bounds = materialise(
        headers.where(F.col("max_tf").isNotNull()).join(weights, ["document_id", "term"])
        .groupBy("query_id", *STRETCH).agg(F.sum(_share(F.col("max_tf"), F.col("min_length"), F.col("defines"))).alias("bound")))
    # Spark keeps so many rows per question and task before the rows of a question meet.
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *STRETCH)
    highest = materialise(bounds.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= probed).select("query_id", *STRETCH))
    first = materialise(_scored(blocks, weights, highest))
    # The k-th score there; it is rounded to four places.
    reached = search.top_hits(first, k).where(F.col("rank") == k).select("query_id", (F.col("score") - 1e-4).alias("least"))
    rest = materialise(
        bounds.join(highest, ["query_id", *STRETCH], "left_anti").join(reached, "query_id", "left")
        .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", *STRETCH))
    hits = search.top_hits(first.unionByName(_scored(blocks, weights, rest)), k)
    return Found(hits, highest.unionByName(rest), bounds, asked)


def matched_terms(found: Found, blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """search.matched_terms of some hits, from the blocks that were read."""
    terms = found.asked.select("query_id", "document_id", "term").distinct()
    wanted = found.read.join(terms, ["query_id", "document_id"]).select(*STRETCH, "term").distinct()
    posted = blocks.join(terms.select("document_id", "term").distinct(), ["document_id", "term"], "left_semi").select(*STRETCH, "term", "posts").join(wanted, [*STRETCH, "term"]).select(
        "document_id", "term", F.explode("posts").alias("p")).select("document_id", "p.page_number", "p.chunk_ordinal", "term")
    return search.matched_terms(hits, posted, found.asked)
