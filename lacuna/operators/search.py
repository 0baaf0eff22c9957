"""BM25 retrieval over chunks, for many questions at once.

Chunks carry (document_id, page_number, chunk_ordinal); statistics are kept per
document, because a question is asked of one document.  Questions are rows:
questions(query_id, document_id, question).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.functions import tokens as T

CHUNK = ["document_id", "page_number", "chunk_ordinal"]
#: What qualifies a figure.  The sentences decide nothing and may be replaced.
WORDING = {
    "risky": "From a table that lost its columns: the value may belong to another one.",
    "repaired": "From repaired text: compare the digits with the page.",
}


def tokenised(chunks: DataFrame) -> DataFrame:
    """Chunk keys with their terms in order; text does not travel further."""
    return chunks.select(
        *CHUNK,
        (F.col("page_quality") != "unreadable").alias("readable"),
        T.is_definition(F.col("text")).alias("defines"),
        T.terms("text").alias("terms"),
    ).withColumn("length", F.size("terms"))


def postings(tokens: DataFrame) -> DataFrame:
    """(chunk, term, tf) for an index over the whole collection; chunk keys name one row each.

    Terms are counted within their row, sorted, so no task gathers the terms of many chunks.
    """
    counted = (
        tokens.select(*CHUNK, "length", F.sort_array("terms").alias("_sorted"))
        .where(F.size("_sorted") > 0)
        .withColumn("_ends", F.filter(
            F.sequence(F.lit(1), F.size("_sorted")),
            lambda i: ~F.get("_sorted", i - 1).eqNullSafe(F.get("_sorted", i)) | (i == F.size("_sorted"))))
        .withColumn("_counted", F.transform("_ends", lambda end, k: F.struct(
            F.get("_sorted", end - 1).alias("term"),
            (end - F.coalesce(F.get("_ends", k - 1), F.lit(0))).cast("long").alias("tf"))))
    )
    return X.unnest(counted.select(*CHUNK, "length", "_counted"), "_counted", "_one").select(
        *CHUNK, F.col("_one.term").alias("term"), F.col("_one.tf").alias("tf"), "length")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """Chunk count and mean length; placeholders of unreadable pages count too."""
    return tokens.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_len"))


def idf(df: Column, n: Column) -> Column:
    return F.when(df > 0, F.ln(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def contribution(weight: Column, idf_: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    """BM25 share of one term met `weight` times in the question."""
    norm = 1 - V.BM25_B + V.BM25_B * F.greatest(length, F.lit(1)) / F.when(avg_len > 0, avg_len).otherwise(1.0)
    return weight * idf_ * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * norm)


def query_terms(questions: DataFrame) -> DataFrame:
    """Expanded question terms by position; repeats are kept, they add weight."""
    listed = questions.select(
        "query_id", "document_id", T.expanded("question").alias("terms")
    )
    return X.unnest(listed, "terms", "term", "position").drop("terms")


def relevant_postings(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of asked-for terms, partitioned by page.

    Each chunk also posts the empty term, which carries its length, so document
    statistics come from the same rows and the text is tokenised once.  The three
    readers (frequencies, statistics, scores) share this one exchange; later
    grouping by chunk and question then needs no further one.  A page's chunks share
    a task; a page is bounded, a document is not.
    """
    vocabulary = (
        asked.select("document_id", "term")
        .unionByName(asked.select("document_id", F.lit("").alias("term")))
        .distinct()
    )
    with_marker = tokenised(chunks).withColumn("terms", F.concat(F.array(F.lit("")), F.col("terms")))
    return (
        X.unnest(with_marker, "terms", "term")
        .drop("terms")
        .where(F.col("document_id").isNotNull() & F.col("term").isNotNull())
        .join(vocabulary, ["document_id", "term"], "left_semi")
        .repartition("document_id", "page_number")
        .groupBy(*CHUNK, "readable", "defines", "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def query_weights(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, term) with multiplicity, idf and document statistics.

    The empty term, one row per chunk, gives a document's chunk count and total length.
    """
    totals = posted.where(F.col("term") == "").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_terms"))
    frequency = (
        posted.groupBy("document_id", "term")
        .agg(F.count(F.lit(1)).alias("df"))
        .join(totals, "document_id")
        .select("document_id", "term", (F.col("_terms") / F.col("_n")).alias("avg_len"), idf(F.col("df"), F.col("_n")).alias("idf"))
    )
    return (
        asked.groupBy("query_id", "document_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
        .join(frequency, ["document_id", "term"])
    )


def scores(posted: DataFrame, weights: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per (question, readable chunk) with a positive score.

    `matched` and `distinctive` count the different terms met, for the evidence floor.
    """
    wanted = questions.select("query_id", T.wants_definition(F.col("question")).alias("wants"))
    weighted = weights.join(wanted, "query_id").select(
        "document_id", "term", "query_id", "weight", "idf", "avg_len", "wants"
    )
    share = contribution(F.col("weight"), F.col("idf"), F.col("tf"), F.col("length"), F.col("avg_len"))
    boost = F.when(F.col("wants") & F.col("defines"), V.DEFINITION_BOOST).otherwise(1.0)
    return (
        posted.join(weighted, ["document_id", "term"])
        .groupBy(*CHUNK, "query_id")
        .agg(
            F.sum(F.when(F.col("readable"), share * boost)).alias("score"),
            F.count(F.lit(1)).alias("matched"),
            F.count_if(F.col("idf") >= V.DISTINCTIVE_IDF).alias("distinctive"),
        )
        .where(F.col("score") > 0)
    )


def top_hits(scored: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """Best k chunks per question; earlier chunks first on equal scores.

    Spark limits each task to k rows per question before the final exchange.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", 9).desc(), F.col("page_number"), F.col("chunk_ordinal")
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("score", F.round("score", 4))
    )


def evidence_floor(hits: DataFrame) -> DataFrame:
    """Keep a question's hits only when its best hit is real evidence.

    The best hit must match two different terms, one of them distinctive.  The
    window holds at most the k hits of a question.
    """
    strong = (
        (F.col("rank") == 1) & (F.col("matched") >= 2) & (F.col("distinctive") >= V.MIN_DISTINCTIVE_TERMS)
    )
    question = Window.partitionBy("query_id")
    return hits.withColumn("_ok", F.bool_or(strong).over(question)).where("_ok").drop("_ok")


def matched_terms(hits: DataFrame, posted: DataFrame, asked: DataFrame) -> DataFrame:
    """Add `matched_terms`: the question's terms met in the hit, in question order."""
    listed = (
        posted.select(*CHUNK, "term")
        .join(hits.select(*CHUNK, "query_id"), CHUNK)
        .join(asked.select("query_id", "term", "position"), ["query_id", "term"])
        .groupBy(*CHUNK, "query_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("_m"))
    )
    return hits.join(
        listed.withColumn("matched_terms", F.transform("_m", lambda m: m["term"])).drop("_m"),
        [*CHUNK, "query_id"],
    )


def selections(questions: DataFrame, evidence: DataFrame, spots: DataFrame) -> DataFrame:
    """Per question: its readable hits, those from risky tables, the unreadable regions on its topic, and whether there is evidence."""
    hits = evidence.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("readable_hits"), F.count_if(F.col("table_risk").isin(V.RISKY_LEVELS)).alias("risky_table_hits"))
    blind = spots.where("query_relevant").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_blind_spots"))
    joined = questions.select("query_id").join(hits, "query_id", "left").join(blind, "query_id", "left").fillna(0)
    return joined.withColumn("has_usable_evidence", F.col("readable_hits") > 0)


def why_matched(matched: Column, named: int | None = V.NAMED_TERMS) -> Column:
    """Distinct matched terms in alphabetical order; the first so many, or all with None."""
    terms = F.array_sort(F.array_distinct(matched))
    return F.concat(F.lit("Matched on: "), F.array_join(terms if named is None else F.slice(terms, 1, named), ", "))


# --- numbers with regulatory force ---------------------------------------------

# Not after a word character or dot; the digit is tested first because it fails soonest.
_NOT_INSIDE = rf"(?={X.DIGIT})(?<![\p{{L}}\p{{N}}_.])"
_MEASURE_BODY = (
    rf"({X.DIGIT}+(?:\.{X.DIGIT}+)?){X.SPACE}*"
    rf"(m(?!{X.WORD})|metre|meter|sqm|sq\.?{X.SPACE}?m|%|ha(?!{X.WORD}))"
)
MEASURE = f"(?i){_NOT_INSIDE}{_MEASURE_BODY}"


def numeric_provisions(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Every measure in the text of `evidence`, with its context and reliability.

    One pass marks the measures; each piece between marks starts with one.
    """
    flat = evidence.withColumn("_flat", X.shield(X.collapse(F.col("text"))))
    pieces = F.split(F.regexp_replace("_flat", MEASURE, X.MARK + "$0"), X.MARK, -1)
    split = flat.withColumn("_pieces", pieces)
    laid = F.arrays_zip(F.col("_pieces").alias("piece"), X.running_lengths(F.col("_pieces")).alias("at"))
    found = F.slice(laid, 2, F.greatest(F.size("_pieces") - 1, F.lit(0)))

    def measure(p: Column) -> Column:
        def part(n: int) -> Column:
            return F.regexp_extract(p["piece"], rf"(?i)\A{_MEASURE_BODY}", n)

        start = F.greatest(p["at"] - V.PROVISION_CONTEXT, F.lit(0))
        stop = F.least(p["at"] + F.length(part(0)) + V.PROVISION_CONTEXT, F.length("_flat"))
        return F.struct(
            p["at"].alias("at"),
            part(1).cast("double").alias("value"),
            F.translate(F.lower(part(2)), ". ", "").alias("unit"),
            F.substring(F.col("_flat"), start + 1, stop - start).alias("context"),
        )

    # Contexts are cut before the explode, so the text is not copied per measure.
    measured = X.unnest(
        split.withColumn("_m", F.transform(found, measure)).drop("_pieces", "_flat", "text"), "_m", "m"
    )
    risky = F.coalesce(F.col("table_risk").isin(V.RISKY_LEVELS), F.lit(False))
    return measured.select(
        *keys,
        "m.at",
        "m.value",
        "m.unit",
        "m.context",
        F.col("text_was_repaired").alias("from_repaired_text"),
        risky.alias("from_risky_table"),
        (~(F.col("text_was_repaired") | risky)).alias("is_reliable"),
        F.when(
            risky,
            WORDING["risky"],
        )
        .when(
            F.col("text_was_repaired"),
            WORDING["repaired"],
        )
        .alias("caveat"),
    )
