"""Text Columns: whitespace, lines, marks, character repair.

Regular expressions spell out the Unicode classes they need, because the JVM's
short classes are ASCII-only.
"""

from collections.abc import Callable
from functools import reduce

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import values as V

# Whitespace, decimal digits and word characters with Unicode meaning.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# What collapsing changes: a longer run, or one that is not a plain space.
_LOOSE_SPACE = rf"{SPACE}{{2,}}|" + SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
SPACE_CHARS = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
])
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
# Characters that end a line, with CR LF taken as one end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
NOT_LINE_END = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# What besides the newline ends a line.
_OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Unicode noncharacters: never valid in exchanged text, so free to use as marks.
MARK = chr(0xFDD0)
HEADING_MARK = chr(0xFDD1)
_RESERVED = MARK + HEADING_MARK


def filled(template: str, **values: Column) -> Column:
    """A sentence whose {names} are replaced by columns; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def unnest(df: DataFrame, array: str | Column, out: str, position: str | None = None) -> DataFrame:
    """One row per array element; empty arrays and null elements give none.

    A plain `explode` makes the optimizer test the array's size first, which
    computes a costly array twice; the outer form is filtered afterwards instead.
    """
    if position:
        exploded = df.select("*", F.posexplode_outer(array).alias(position, out))
    else:
        exploded = df.select("*", F.explode_outer(array).alias(out))
    return exploded.where(F.col(out).isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shield(text: Column) -> Column:
    """Replace reserved marks by U+FFFD, keeping every offset."""
    present = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(HEADING_MARK))
    safe = F.translate(text, _RESERVED, chr(0xFFFD) * len(_RESERVED))
    return F.when(present, safe).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """Whitespace runs become one space; no space at either end."""
    return F.btrim(F.regexp_replace(text, _LOOSE_SPACE, " "))


def lines_with_ends(text: Column) -> Column:
    """Lines including their terminators; concatenated they give the text back."""
    return F.regexp_extract_all(
        text, F.lit(rf"{NOT_LINE_END}*(?:{LINE_END})|{NOT_LINE_END}+\z"), F.lit(0)
    )


def numbered_lines(text: Column) -> Column:
    """Lines as (line, size, text); size counts the terminator.

    Text whose only line end is the newline, nearly all text, is split directly.
    """
    def numbered(plain: Column) -> Column:
        last = F.size(plain) - 1
        return F.transform(
            plain,
            lambda s, i: F.struct(i.alias("line"), (F.length(s) + (i < last).cast("int")).alias("size"), s.alias("text")),
        )

    # Only what follows a newline at the end of the text has no size.
    by_newline = F.filter(once(F.split(text, "\n", -1), numbered), lambda s: s["size"] > 0)
    by_any_end = F.transform(
        lines_with_ends(text),
        lambda s, i: F.struct(
            i.alias("line"), F.length(s).alias("size"), F.regexp_replace(s, rf"(?:{LINE_END})\z", "").alias("text")
        ),
    )
    # Looking for one character is far cheaper than trying a class of them at every place.
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _OTHER_LINE_ENDS])
    return F.when(other, by_any_end).otherwise(by_newline)


def lines(text: Column) -> Column:
    return F.transform(numbered_lines(text), lambda s: s["text"])


def running_totals(numbers: Column) -> Column:
    """Sum of the numbers before each position."""
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos"))
    return F.aggregate(
        numbers,
        zero,
        lambda acc, n: F.struct(
            F.concat(acc["at"], F.array(acc["pos"])).alias("at"), (acc["pos"] + n).alias("pos")
        ),
        lambda acc: acc["at"],
    )


def running_lengths(pieces: Column) -> Column:
    """Offset at which each piece starts, given pieces laid end to end."""
    return running_totals(F.transform(pieces, F.length))


def match_starts(text: Column, pattern: str) -> Column:
    """Offsets of all non-overlapping matches of `pattern`."""
    pieces = F.split(F.regexp_replace(shield(text), f"(?:{pattern})", MARK + "$0"), MARK, -1)
    starts = running_lengths(pieces)
    return F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))


# --- character repair ---------------------------------------------------------

_SUSPECT_CLASS = (
    "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in V.SUSPECT_RANGES)
    + "&&[^" + "".join(rf"\x{{{c:x}}}" for c in V.LEGITIMATE_TYPOGRAPHY) + "]]"
)


_BAD_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in V.BAD_CHARS) + "]"


def has_wide_chars(text: Column) -> Column:
    """Any character past Latin-1; without one there is nothing to repair or suspect."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x00-\xff]")


def repaired(raw: Column) -> Column:
    """One-to-one character repair; offsets are unchanged."""
    return F.when(has_wide_chars(raw), F.translate(raw, V.BAD_CHARS, V.GOOD_CHARS)).otherwise(raw)


def substitutions(raw: Column) -> Column:
    return F.when(has_wide_chars(raw), F.regexp_count(raw, F.lit(_BAD_CLASS))).otherwise(0)


def distinct_substitutions(raw: Column) -> Column:
    found = [F.contains(raw, F.lit(c)).cast("int") for c in V.BAD_CHARS]
    return F.when(has_wide_chars(raw), reduce(lambda a, b: a + b, found)).otherwise(0)


def suspect_chars(text: Column) -> Column:
    """Every suspect character of the text, in order."""
    return F.regexp_extract_all(text, F.lit(_SUSPECT_CLASS), F.lit(0))


def suspect_count(text: Column) -> Column:
    return F.when(has_wide_chars(text), F.regexp_count(text, F.lit(_SUSPECT_CLASS))).otherwise(0)


def is_clean(raw: Column) -> Column:
    return suspect_count(repaired(raw)) == 0


def corruption_rate(raw: Column) -> Column:
    """Substitutions per 1,000 characters; 0 for empty text."""
    return F.when(F.length(raw) == 0, F.lit(0.0)).otherwise(
        F.round(1000 * substitutions(raw) / F.length(raw), 3)
    )


def codepoint(ch: Column) -> Column:
    """`U+XXXX` of a one-character string."""
    return F.format_string("U+%04X", F.ascii(ch))


NUMERIC_CLAUSE = rf"(?<!{WORD}){DIGIT}{{1,4}}(?:\.{DIGIT}+)?{SPACE}?m(?!{WORD})"


def numeric_clauses(text: Column) -> Column:
    """Measures in metres with their offsets."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(NUMERIC_CLAUSE), F.lit(0)).alias("clause"),
        match_starts(text, NUMERIC_CLAUSE).alias("at"),
    )


def highlight(text: Column, start: Column, end: Column) -> Column:
    """Text before, inside and after a span, the end held within the text."""
    stop = F.least(F.greatest(end, start), F.length(text))
    return F.struct(
        F.substring(text, F.lit(1), start).alias("before"),
        F.substring(text, start + 1, stop - start).alias("marked"),
        F.substring(text, stop + 1, F.length(text)).alias("after"),
    )
