"""Cutting pages into citable passages along the document's own structure.

All boundaries fall at line starts or line ends.  Each boundary pattern marks
its matches in the page text, the marks are laid onto the page's lines, and one
split yields the segments, so a page is cut in linear time inside a projection.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.operators import tables

SECTION = (
    rf"(?md)^{X.SPACE}*({X.DIGIT}+(?:\.{X.DIGIT}+){{1,3}}){X.SPACE}+([A-Z][^\n]{{3,120}})$"
)
CLAUSE_BODY = rf"^{X.SPACE}*(?:([ivxlcdm]{{1,7}})\.|\(([a-z])\)|({X.DIGIT}{{1,2}})\.){X.SPACE}+"
CLAUSE = rf"(?md){CLAUSE_BODY}"
# What may not stand before the word is looked at once the word is there.
CAPTION_LINE = rf"(?md)^.*Table(?<!{X.WORD}Table){X.SPACE}+{X.DIGIT}+{X.SPACE}*:.*$"
SENTENCE_GAP = rf"(?<=[.;:]){X.SPACE}+(?=[A-Z(])"
CLAUSE_AT_START = rf"(?d)\A{CLAUSE_BODY[1:]}"
# The same or nothing: it matches in any case, so no later place of a segment is tried.
_CLAUSE_OPENING = rf"(?d)\A(?:{CLAUSE_BODY[1:]})?"

_LONG = V.MAX_CHUNK_CHARS
# Longest run of whole sentences that fits, else one over-long sentence alone.
_PACK = rf"{X.MARK}?((?s:.{{1,{_LONG}}})(?={X.MARK}|\z)|[^{X.MARK}]+)"
# What is left when it fits, else up to the last space of the second half, else a full cut.
_CUT = rf"(?s).{{1,{_LONG}}}\z|.{{{_LONG // 2},{_LONG - 1}}}(?= )|.{{{_LONG}}}"


def _marked_lines(text: Column, pattern: str, replacement: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, replacement), "\n", -1)


def _segments(plain: Column) -> Column:
    """Page text cut at every boundary; a heading's segment opens with a mark."""
    lined = F.arrays_zip(
        F.split(plain, "\n", -1).alias("body"),
        _marked_lines(plain, SECTION, X.MARK + "$0").alias("section"),
        _marked_lines(plain, CLAUSE, X.MARK + "$0").alias("clause"),
        _marked_lines(plain, CAPTION_LINE, X.MARK + "$0" + X.HEADING_MARK).alias("caption"),
    )

    def rebuilt(line: Column) -> Column:
        heading = F.startswith(line["section"], F.lit(X.MARK))
        opens = (
            heading
            | F.startswith(line["clause"], F.lit(X.MARK))
            | F.startswith(line["caption"], F.lit(X.MARK))
        )
        return F.concat(
            F.when(opens, X.MARK).otherwise(""),
            F.when(heading, X.HEADING_MARK).otherwise(""),
            line["body"],
            F.when(F.endswith(line["caption"], F.lit(X.HEADING_MARK)), X.MARK).otherwise(""),
        )

    return F.split(F.array_join(F.transform(lined, rebuilt), "\n"), X.MARK, -1)


def _placed(segments: Column) -> Column:
    """Segments with their offset and the number of headings met so far.

    The running heading count is the as-of join: a segment belongs to the latest
    heading at or before it, and counting never leaves the page.
    """
    zero = F.struct(
        F.array().cast("array<struct<body:string,at:int,heading:int>>").alias("done"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("heading"),
    )

    def step(acc: Column, segment: Column) -> Column:
        opens = F.startswith(segment, F.lit(X.HEADING_MARK))
        body = F.when(opens, F.substring(segment, 2, 1 << 30)).otherwise(segment)
        heading = acc["heading"] + opens.cast("int")
        placed = F.struct(body.alias("body"), acc["pos"].alias("at"), heading.alias("heading"))
        return F.struct(
            F.concat(acc["done"], F.array(placed)).alias("done"),
            (acc["pos"] + F.length(body)).alias("pos"),
            heading.alias("heading"),
        )

    return F.aggregate(segments, zero, step, lambda acc: acc["done"])


def hard_split(text: Column) -> Column:
    """Pieces of at most 1,400 characters, cut at whitespace where possible."""
    return F.regexp_extract_all(text, F.lit(_CUT), F.lit(0))


def packed(text: Column) -> Column:
    """Whole sentences packed greedily into pieces of at most 1,400 characters.

    Sentence gaps become one mark, so the regex engine's greedy match is the
    greedy packer; only a single sentence longer than the limit exceeds it.
    """
    marked = F.regexp_replace(X.shield(text), SENTENCE_GAP, X.MARK)
    found = F.regexp_extract_all(marked, F.lit(_PACK), F.lit(1))
    return F.transform(found, lambda p: F.translate(p, X.MARK, " "))


def _cut_piece(piece: Column, base: Column) -> Column:
    cut = hard_split(piece)
    laid = F.transform(
        F.arrays_zip(cut.alias("part"), X.running_lengths(cut).alias("off")),
        lambda c: F.struct(X.strip(c["part"]).alias("text"), (base + c["off"]).alias("at")),
    )
    return F.when(F.length(piece) <= _LONG, F.array(F.struct(piece.alias("text"), base.alias("at")))).otherwise(
        F.filter(laid, lambda c: F.length(c["text"]) > 0)
    )


def _merged(pieces: Column) -> Column:
    """Join pieces under 60 characters onto the piece before them."""
    kept_at = F.transform(
        F.filter(pieces, lambda p, i: (i == 0) | (F.length(p["text"]) >= V.MIN_CHUNK_CHARS)),
        lambda p: p["at"],
    )
    joined = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.concat(
                F.when(i == 0, "").when(F.length(p["text"]) < V.MIN_CHUNK_CHARS, " ").otherwise(X.MARK),
                p["text"],
            ),
        ),
        "",
    )
    return F.transform(
        F.arrays_zip(F.split(joined, X.MARK, -1).alias("text"), kept_at.alias("at")),
        lambda p: F.struct(X.strip(p["text"]).alias("text"), p["at"].alias("at")),
    )


def with_pieces(segments: DataFrame) -> DataFrame:
    """Add `pieces` (text, offset) to rows with `cleaned` and `at`."""
    long = F.length("cleaned") > _LONG
    sentences = segments.withColumn("_packed", F.when(long, packed(F.col("cleaned"))))
    offsets = X.running_totals(F.transform("_packed", lambda p: F.length(p) + 1))
    cut = sentences.withColumn("_offsets", F.when(long, offsets)).withColumn(
        "_cut",
        F.flatten(
            F.transform(
                F.arrays_zip(F.col("_packed").alias("piece"), F.col("_offsets").alias("off")),
                lambda p: _cut_piece(p["piece"], F.col("at") + p["off"]),
            )
        ),
    )
    whole = F.array(F.struct(F.col("cleaned").alias("text"), F.col("at").alias("at")))
    return cut.withColumn("pieces", F.when(long, _merged(F.col("_cut"))).otherwise(whole)).drop(
        "_packed", "_offsets", "_cut"
    )


def with_segments(pages: DataFrame, running_header: str | None = None) -> DataFrame:
    """Add `segments`: cleaned segments of at least 60 characters of each page."""
    header = "(?iu)" + running_header.replace(r"\s", X.SPACE) if running_header else None

    def cleaned(segment: Column) -> Column:
        body = segment["body"]

        def marker(opening: Column) -> Column:
            return F.concat(*[F.regexp_extract(opening, CLAUSE_AT_START, n) for n in (1, 2, 3)])

        heading = F.when(segment["heading"] > 0, segment["heading"])
        return F.struct(
            X.strip(F.regexp_replace(body, header, "") if header else body).alias("cleaned"),
            segment["at"].alias("at"),
            # Read twice on purpose: a column read once would be computed per segment.
            F.try_element_at(F.col("_headings"), heading)["number"].alias("section_number"),
            X.strip(F.try_element_at(F.col("_headings"), heading)["title"]).alias("section_title"),
            F.nullif(X.once(F.regexp_extract(body, _CLAUSE_OPENING, 0), marker), F.lit("")).alias("clause_marker"),
        )

    plain = pages.withColumn("_plain", X.shield(F.col("text")))
    laid = (
        plain.withColumn(
            "_headings",
            F.arrays_zip(
                F.regexp_extract_all("_plain", F.lit(SECTION), F.lit(1)).alias("number"),
                F.regexp_extract_all("_plain", F.lit(SECTION), F.lit(2)).alias("title"),
            ),
        ).withColumn("_placed", _placed(_segments(F.col("_plain"))))
    )
    kept = F.filter(
        F.transform(F.filter("_placed", lambda s: F.length(s["body"]) >= V.MIN_CHUNK_CHARS), cleaned),
        lambda s: F.length(s["cleaned"]) >= V.MIN_CHUNK_CHARS,
    )
    return laid.withColumn("segments", kept).drop("_plain", "_headings", "_placed")


def with_whole_page(pages: DataFrame) -> DataFrame:
    """Add `segments` of with_segments to pages of running text: each page is one, of no section and no clause."""
    none = [F.lit(None).cast("string").alias(c) for c in ("section_number", "section_title", "clause_marker")]
    whole = F.struct(X.strip(F.col("text")).alias("cleaned"), F.lit(0).alias("at"), *none)
    return pages.withColumn("segments", F.filter(F.array(whole), lambda s: F.length(s["cleaned"]) >= V.MIN_CHUNK_CHARS))


def overlapping_region(regions: Column, start: Column, end: Column) -> Column:
    """First table region that shares characters with the span."""
    return F.try_element_at(
        F.filter(regions, lambda r: (start < r["char_end"]) & (end > r["char_start"])), F.lit(1)
    )


def chunk_pages(graded: DataFrame, running_header: str | None = None, structured: bool = True) -> DataFrame:
    """Chunks of graded pages; an unreadable page yields one placeholder.

    Pages that are known to be running text are cut by length alone if not `structured`:
    a line of theirs that opens with an address such as 10.0.0.1 is no heading, and
    they hold no tables.

    A projection from end to end: page text is read once and nothing is shuffled.
    Only the columns a chunk needs pass the explode, so a long page is not copied
    once per chunk.  `chunk_ordinal` orders chunks inside (document_id, page_number).
    """
    unreadable = F.col("quality") == "unreadable"
    laid = tables.with_regions(graded)
    if structured:
        cut = with_segments(laid, running_header)
    else:
        cut = with_whole_page(laid.withColumn("regions", F.slice("regions", 1, 0)))
    placeholder = F.struct(
        F.format_string(
            "[Page %d contains no machine-readable text. It is a scan or drawing and has been "
            "rendered as an image.]",
            "page_number",
        ).alias("cleaned"),
        F.lit(0).alias("at"),
        *[F.lit(None).cast("string").alias(c) for c in ("section_number", "section_title", "clause_marker")],
    )
    segments = F.when(unreadable, F.array(placeholder)).otherwise(F.col("segments"))
    slim = F.transform(
        "regions",
        lambda r: F.struct(*[r[c].alias(c) for c in ("char_start", "char_end", "caption", "risk", "warning")]),
    )
    slimmed = cut.select(
        "document_id",
        "page_number",
        "quality",
        "substitutions",
        "caveat",
        F.length("text").alias("_text_length"),
        F.when(~unreadable, slim).alias("_regions"),
        segments.alias("_segments"),
    )
    exploded = X.unnest(slimmed, "_segments", "_segment").select("*", "_segment.*").drop("_segment", "_segments")
    start = F.col("_piece.at")
    end = start + F.length("_piece.text")
    pieces = X.unnest(with_pieces(exploded), "pieces", "_piece").withColumn(
        "_region", overlapping_region(F.col("_regions"), start, end)
    )
    return pieces.select(
        "document_id",
        "page_number",
        start.alias("char_start"),
        F.when(unreadable, F.greatest("_text_length", F.lit(1)))
        .otherwise(F.least(end, F.col("_text_length")))
        .alias("char_end"),
        F.col("_piece.text").alias("text"),
        "section_number",
        "section_title",
        "clause_marker",
        F.col("quality").alias("page_quality"),
        (~unreadable & (F.col("substitutions") > 0)).alias("text_was_repaired"),
        F.col("_region.risk").alias("table_risk"),
        F.col("_region.caption").alias("table_caption"),
        F.array_compact(F.array(F.col("caveat"), F.col("_region.warning"))).alias("caveats"),
        F.concat_ws(
            ":",
            "document_id",
            F.concat(F.lit("p"), F.col("page_number")),
            F.when(unreadable, "unreadable").otherwise(start.cast("string")),
        ).alias("chunk_id"),
        start.alias("chunk_ordinal"),
    )


def citation_label() -> Column:
    """`§n (m) p. k` with absent parts skipped."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("§"), F.col("section_number")),
        F.concat(F.lit("("), F.col("clause_marker"), F.lit(")")),
        F.concat(F.lit("p. "), F.col("page_number")),
    )


def safe_to_quote() -> Column:
    return ~F.col("text_was_repaired") & (
        F.col("table_risk").isNull() | F.col("table_risk").isin("none", "low")
    )
