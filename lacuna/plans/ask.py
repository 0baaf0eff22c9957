"""From pages to answers: ingest, search, report what could not be read."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.operators import blind, chunks, pages, search
from lacuna.session import materialise


@dataclass
class Answers:
    """Lazy results of one batch of questions."""

    hits: DataFrame
    blind_spots: DataFrame
    coverage_notes: DataFrame
    regions: DataFrame
    weights: DataFrame


def ingest(raw_pages: DataFrame, running_header: str | None = None) -> DataFrame:
    """Chunks of pages(document_id, page_number, raw_text); a pattern names the document's running header."""
    return chunks.chunk_pages(pages.grade_pages(raw_pages), running_header)


def answer(chunked: DataFrame, questions: DataFrame, k: int = V.TOP_K) -> Answers:
    """Hits, unreadable regions and coverage notes of all questions.

    Terms asked for, their postings, the kept hits and the unreadable regions are
    small next to the corpus and read by several outputs, so each is stored once; by
    their stored size Spark decides whether to broadcast them.
    """
    asked = materialise(search.query_terms(questions))
    posted = materialise(search.relevant_postings(chunked, asked))
    weights = materialise(search.query_weights(posted, asked))
    ranked = search.top_hits(search.scores(posted, weights, questions), k)
    kept = materialise(search.evidence_floor(ranked))
    regions = materialise(blind.blind_regions(chunked))
    spots = blind.match_regions(regions, weights, kept)
    hits = search.matched_terms(kept, posted, asked)
    return Answers(hits, spots, blind.coverage_notes(spots), regions, weights)


def evidence(chunked: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the passage they point at and everything that qualifies it."""
    return (
        chunked.where(F.col("page_quality") != "unreadable")
        .join(hits, search.CHUNK)
        .select(
            "query_id",
            "rank",
            *search.CHUNK,
            "chunk_id",
            "char_start",
            "char_end",
            X.collapse(F.col("text")).alias("quote"),
            chunks.citation_label().alias("citation_label"),
            F.col("section_number").alias("section"),
            "page_quality",
            "text_was_repaired",
            chunks.safe_to_quote().alias("is_safe_verbatim"),
            "table_risk",
            "table_caption",
            "caveats",
            search.why_matched(F.col("matched_terms")).alias("why_matched"),
            "matched_terms",
            "score",
        )
    )
