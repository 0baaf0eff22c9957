"""Unreadable regions that bear on a question."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.functions import tokens as T
from lacuna.operators.ranges import islands, rank_rows

REGION = ["document_id", "page_start", "page_end"]
_BIN = 64


def page_ends(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add to wanted (document_id, page_number, side) the end of the page's readable text that faces the region.

    side -1: the page's last DESCRIPTOR_TAIL characters; 1: its first.  Of each chunk
    only so much is grouped as can show; the ends of a page's chunks, joined, end as the
    page does.  Only chunks of wanted pages have their whitespace collapsed.
    """
    shown = F.lit(V.DESCRIPTOR_TAIL)
    text = X.collapse(F.col("text"))
    readable = chunks.where(F.col("page_quality") != "unreadable").select("document_id", "page_number", "chunk_ordinal", "text")
    facing = F.when(F.col("side") < 0, F.right(text, shown)).otherwise(F.left(text, shown))
    return (
        readable.join(wanted, ["document_id", "page_number"])
        .groupBy(*REGION, "side")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_ordinal", facing.alias("text")))).alias("_c"))
        .withColumn("page_text", F.array_join(F.transform("_c", lambda c: c["text"]), " "))
        .drop("_c")
    )


def blind_regions(chunks: DataFrame) -> DataFrame:
    """Runs of unreadable pages, each with the text that leads in and out."""
    unreadable = chunks.where(F.col("page_quality") == "unreadable")
    runs = islands(unreadable, "document_id", "page_number")
    neighbours = runs.select(*REGION, (F.col("page_start") - 1).alias("page_number"), F.lit(-1).alias("side")).union(
        runs.select(*REGION, (F.col("page_end") + 1).alias("page_number"), F.lit(1).alias("side"))
    )
    texts = page_ends(chunks, neighbours)
    beside = texts.groupBy(*REGION).agg(
        F.max(F.when(F.col("side") == -1, F.col("page_text"))).alias("before"),
        F.max(F.when(F.col("side") == 1, F.col("page_text"))).alias("after"),
    )
    return runs.join(beside, REGION, "left").select(
        *REGION,
        (F.col("page_end") - F.col("page_start") + 1).alias("page_count"),
        F.lit(V.BLIND_REASON).alias("reason"),
        F.btrim(F.coalesce(F.right("before", F.lit(V.DESCRIPTOR_TAIL)), F.lit(""))).alias("descriptor"),
        F.btrim(F.coalesce(F.left("after", F.lit(V.FOLLOWING_HEAD)), F.lit(""))).alias("following_context"),
        F.right("before", F.lit(V.NEAREST_TAIL)).alias("nearest_readable_context"),
    )


def region_terms(regions: DataFrame) -> DataFrame:
    """Terms of each region's introduction with their counts."""
    described = regions.select(*REGION, T.terms("descriptor").alias("terms"))
    return (
        X.unnest(described.withColumn("length", F.size("terms")), "terms", "term")
        .groupBy(*REGION, "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def region_scores(regions: DataFrame, weights: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Lexical match of (question, region) pairs: those given, or all that share a term.

    `weights` holds one row per question and term with its idf.  With `pairs`, a
    term that many questions ask for meets only the regions that are asked about.
    """
    known = weights.select("query_id", "document_id", "term", "idf")
    posted = region_terms(regions)
    if pairs is None:
        met = posted.join(known, ["document_id", "term"])
    else:
        met = posted.join(pairs.select("query_id", *REGION), REGION).join(known, ["query_id", "document_id", "term"])
    return (
        met.groupBy(*REGION, "query_id")
        .agg(
            (F.sum(F.col("idf") * F.col("tf")) / (1 + F.ln(1 + F.max("length")))).alias("match_score"),
            F.array_sort(F.collect_list("term")).alias("matched_terms"),
            F.count_if(F.col("idf") >= V.DISTINCTIVE_IDF).alias("distinctive"),
        )
        .withColumn(
            "query_relevant",
            (F.col("match_score") > 0) & (F.col("distinctive") >= V.MIN_DISTINCTIVE_TERMS),
        )
        .withColumn("match_score", F.round("match_score", 4))
        .drop("distinctive")
    )


def on_topic(regions: DataFrame, weights: DataFrame) -> DataFrame:
    """(question, region) pairs that share a distinctive term, without which none is relevant."""
    rare = weights.where(F.col("idf") >= V.DISTINCTIVE_IDF).select("query_id", "document_id", "term")
    return region_terms(regions).join(rare, ["document_id", "term"]).select("query_id", *REGION).distinct()


def near_hits(regions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question, region) pairs with a hit within three pages of the region.

    Both sides meet on page bins, so the range condition runs as an equi-join.
    """
    low = F.col("page_start") - V.PROXIMITY_PAGES
    high = F.col("page_end") + V.PROXIMITY_PAGES
    binned = regions.select(
        *REGION, F.explode(F.sequence(F.floor(low / _BIN), F.floor(high / _BIN))).alias("_bin")
    )
    pages = hits.select("query_id", "document_id", "page_number").distinct()
    return (
        pages.withColumn("_bin", F.floor(F.col("page_number") / _BIN))
        .join(binned, ["document_id", "_bin"])
        .where((F.col("page_number") >= low) & (F.col("page_number") <= high))
        .select("query_id", *REGION)
        .distinct()
    )


def match_regions(regions: DataFrame, weights: DataFrame, hits: DataFrame) -> DataFrame:
    """Regions to report per question: on topic, or next to a hit that passed the floor."""
    pair = ["query_id", *REGION]
    near = near_hits(regions, hits)
    scored = region_scores(regions, weights, on_topic(regions, weights).union(near).distinct())
    near = near.withColumn("near_hit", F.lit(True))
    reported = (
        scored.join(near, pair, "full")
        .withColumn("query_relevant", F.coalesce("query_relevant", F.lit(False)))
        .withColumn("near_hit", F.coalesce("near_hit", F.lit(False)))
        .withColumn("match_score", F.coalesce("match_score", F.lit(0.0)))
        .withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))
        .where(F.col("query_relevant") | F.col("near_hit"))
        .join(regions, REGION)
    )
    order = [("query_relevant", True), ("match_score", True), ("page_count", True)]
    return rank_rows(reported, "query_id", order, "page_start", "rank")


def page_span(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("p. %d", start)).otherwise(
        F.format_string("pp. %d-%d", start, end)
    )


def coverage_notes(matched: DataFrame, named_regions: int = V.NAMED_REGIONS) -> DataFrame:
    """The sentence shown above an answer when pages on the topic are unreadable.

    Relevant regions rank first, so those named are the first by rank; all are counted.
    """
    named = F.when(F.col("rank") <= named_regions, F.struct("rank", page_span(F.col("page_start"), F.col("page_end")).alias("s")))
    totals = matched.where(F.col("query_relevant")).groupBy("query_id").agg(
        F.sum("page_count").alias("pages"),
        F.count(F.lit(1)).alias("regions"),
        F.array_sort(F.collect_list(named)).alias("_w"),
    )
    return totals.select(
        "query_id",
        F.format_string(
            "%d page(s) of this document bearing on your question could not be read "
            "(%d region(s): %s) and are not included in the evidence below.",
            "pages",
            "regions",
            F.array_join(F.transform("_w", lambda w: w["s"]), ", "),
        ).alias("coverage_note"),
    )


def describe(before_chars: int = V.DESCRIBED_BEFORE, after_chars: int = V.DESCRIBED_AFTER) -> Column:
    """One region in words, with so much of the text around it."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.format_string("page %d", "page_start")).otherwise(
        F.format_string("pages %d–%d (%d pages)", "page_start", "page_end", "page_count")
    )
    return F.concat(
        pages,
        F.lit(": "),
        F.col("reason"),
        F.lit("."),
        F.when(
            F.col("descriptor") != "",
            F.format_string(" The text immediately before it reads: “%s”", F.left("descriptor", F.lit(before_chars))),
        ).otherwise(""),
        F.when(
            F.col("following_context") != "",
            F.format_string(" The text immediately after it reads: “%s”", F.left("following_context", F.lit(after_chars))),
        ).otherwise(""),
    )


def page_images(base: str = "/api/corpus/page", at_most: int | None = None) -> Column:
    """Image addresses of a region's pages, all or the first so many."""
    last = F.col("page_end") if at_most is None else F.least(F.col("page_end"), F.col("page_start") + (at_most - 1))
    return F.transform(
        F.sequence("page_start", last),
        lambda p: F.concat(F.lit(base + "/"), p.cast("string"), F.lit("/image")),
    )
