"""How the driver's tables stand in for pages, places and statements.

Each stand-in is derived from a whole table, in Spark here and in SQL beside it.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.operators.ranges import number_rows
from lacuna.sources.tables import read_table

LENGTH_LIMIT = V.MIN_TEXT_CHARS


def finish(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, the type SQL engines give them."""
    return df.select(
        *[
            F.col(f.name).cast("long").alias(f.name)
            if f.dataType.typeName() in ("integer", "short", "byte")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def sql_text(value: str) -> str:
    """A SQL string literal, non-ASCII characters by code."""
    parts, plain = [], ""
    for ch in value:
        if 32 <= ord(ch) < 127:
            plain += "''" if ch == "'" else ch
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")"


def filled_sql(template: str, **values: str) -> str:
    """text.filled as SQL; values are expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"({values[p]})" if i % 2 else sql_text(p) for i, p in enumerate(parts) if p) + ")"


# --- documents: a source is a document, its texts in id order are the pages --------

def pages(spark: SparkSession, sf_dir: str, up_to: int | None = None) -> DataFrame:
    """All pages, or the first so many of each document."""
    # Numbering deals the texts out by source and bucket, so no other spreading is needed.
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("document_id"), F.col("text").alias("raw_text"), "n_chars"
    )
    return number_rows(docs, "document_id", "doc_id", "page_number", up_to=up_to)


PAGES = """pages_in AS (
  SELECT doc_id, source AS document_id, text AS raw_text, n_chars,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number
  FROM documents)"""

# Character faults put in, by text length: none, rare, dense, dense plus unknown.
_FAULTS = {g: b for b, g in reversed([(chr(b), g) for b, g in V.REPAIR_PAIRS])}
FAULT_FROM = "".join(_FAULTS)
FAULT_TO = "".join(_FAULTS.values())
UNKNOWN = chr(0x0501)


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_chars") % 4
    dense = F.translate("raw_text", FAULT_FROM, FAULT_TO)
    damaged = (
        F.when(kind == 1, F.translate("raw_text", "q", _FAULTS["q"]))
        .when(kind == 2, dense)
        .when(kind == 3, F.concat(dense, F.lit(UNKNOWN)))
        .otherwise(F.col("raw_text"))
    )
    return pages(spark, sf_dir).withColumn("original", F.col("raw_text")).withColumn("raw_text", damaged)


_DENSE = f"translate(raw_text, {sql_text(FAULT_FROM)}, {sql_text(FAULT_TO)})"
DAMAGED = f"""{PAGES}, damaged AS (
  SELECT doc_id, document_id, page_number, raw_text AS original,
    CASE n_chars % 4 WHEN 1 THEN translate(raw_text, 'q', {sql_text(_FAULTS['q'])})
      WHEN 2 THEN {_DENSE} WHEN 3 THEN {_DENSE} || {sql_text(UNKNOWN)} ELSE raw_text END AS raw_text
  FROM pages_in)"""

_BAD, _GOOD = sql_text(V.BAD_CHARS), sql_text(V.GOOD_CHARS)
_SUSPECT = "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in V.SUSPECT_RANGES) + "]"
GRADED = f"""{DAMAGED}, measured AS (
  SELECT *, translate(raw_text, {_BAD}, {_GOOD}) AS text,
    length(raw_text) - length(translate(raw_text, {_BAD}, '')) AS substitutions,
    length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) AS raw_chars
  FROM damaged), rated AS (
  SELECT *, len(regexp_extract_all(text, '{_SUSPECT}')) AS suspects,
    length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count,
    CASE WHEN length(raw_text) = 0 THEN 0.0 ELSE round(1000.0::DOUBLE * substitutions / length(raw_text), 3) END AS corruption_rate
  FROM measured), graded AS (
  SELECT *, CASE WHEN raw_chars < 120 THEN 'unreadable' WHEN suspects > 0 THEN 'residual_corruption'
    WHEN corruption_rate > 4.0 THEN 'heavily_repaired' WHEN substitutions > 0 THEN 'repaired' ELSE 'clean' END AS quality
  FROM rated)"""
SUSPECT_SQL = _SUSPECT


# --- structure put into the lines of a text, by line length -------------------------

_ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii"]


def structured_pages(spark: SparkSession, sf_dir: str, up_to: int | None = None) -> DataFrame:
    marked = f"array_join(transform(split(raw_text, '\\n', -1), (l, i0) -> {_line_sql('(i0 + 1)', 'array({})', 'int')}), '\\n')"
    return pages(spark, sf_dir, up_to).withColumn("raw_text", F.expr(marked))


def _line_sql(i: str = "i", array: str = "[{}]", whole: str = "INT") -> str:
    """What becomes of line `l`, number `i`; the same text for both engines."""
    rows = ""
    for r in (1, 2, 3, 4):
        row = (
            f"chr(10) || '{r} Lot ' || (length(l) % 9) || '.{10 + r} ' || (length(l) % 7) || '.5' || "
            f"(CASE WHEN (length(l) + {r}) % 3 = 0 THEN '' ELSE ' 1.{20 + r}' END)"
        )
        rows += f" || {row}" if r < 4 else f" || (CASE WHEN length(l) % 2 = 0 THEN {row} ELSE '' END)"
    roman = array.format(", ".join(f"'{x}'" for x in _ROMAN))
    roman = f"{roman}[length(l) % 7{' + 1' if array == '[{}]' else ''}]"
    return f"""CASE length(l) % 6
      WHEN 0 THEN {i} || '.' || (length(l) % 50 + 1) || ' Provision ' || length(l) || chr(10) || l
      WHEN 1 THEN '(' || chr(cast(97 + length(l) % 26 AS {whole})) || ') ' || l
      WHEN 2 THEN (1 + length(l) % 99) || '. ' || l
      WHEN 3 THEN {roman} || '. ' || l
      WHEN 4 THEN 'Table ' || {i} || ': ' || (CASE WHEN length(l) % 5 = 0 THEN 'Limits' ELSE 'Base and total limits' END)
        || ' of lot ' || length(l){rows} || chr(10) || l
      ELSE l || ' Keep a buffer of ' || (length(l) % 90 + 5) || ' m from the edge of the lake.' END"""


STRUCTURED = f"""{PAGES}, structured AS (
  SELECT doc_id, document_id, page_number,
    array_to_string(list_transform(string_split(raw_text, chr(10)), lambda l, i: {_line_sql()}), chr(10)) AS text
  FROM pages_in)"""


# --- questions: every benchmark text asked of one document ---------------------------

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("document_id"),
        F.col("text").alias("question"),
    )


QUESTIONS = """questions AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS document_id, text AS question FROM benchmark)"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one chunk; short texts and, as scans, every fifth length are unreadable."""
    short = (F.length(F.btrim("raw_text", F.lit(" \n"))) < LENGTH_LIMIT) | (F.col("n_chars") % 5 == 0)
    placeholder = F.format_string("[Page %d contains no machine-readable text.]", "page_number")
    return pages(spark, sf_dir).select(
        "document_id",
        "page_number",
        F.col("doc_id").alias("chunk_ordinal"),
        F.when(short, "unreadable").otherwise("clean").alias("page_quality"),
        F.when(short, placeholder).otherwise(F.col("raw_text")).alias("text"),
    )


CHUNKS = f"""{PAGES}, chunks AS (
  SELECT document_id, page_number, doc_id AS chunk_ordinal,
    CASE WHEN length(trim(raw_text, ' ' || chr(10))) < 120 OR n_chars % 5 = 0 THEN 'unreadable' ELSE 'clean' END AS page_quality,
    CASE WHEN length(trim(raw_text, ' ' || chr(10))) < 120 OR n_chars % 5 = 0
      THEN '[Page ' || page_number || ' contains no machine-readable text.]' ELSE raw_text END AS text
  FROM pages_in)"""

_STOP = "(" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + ")"
STOP_SQL = _STOP


def terms_sql(name: str, source: str, keys: str, text: str) -> str:
    """CTE `name`(keys, pos, sub, term): terms of a text column in order."""
    stem = (
        "CASE WHEN length(t) <= 3 OR NOT regexp_full_match(t, '[a-z]+') THEN NULL "
        "WHEN t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' "
        "WHEN regexp_matches(t, '(s|x|z|ch|sh)es$') THEN left(t, length(t) - 2) "
        "WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) END"
    )
    return f"""{name}_raw AS (
  SELECT {keys}, generate_subscripts(w, 1) AS pos, lower(unnest(w)) AS t
  FROM (SELECT {keys}, regexp_extract_all({text}, '[A-Za-z]+|[0-9]+(?:\\.[0-9]+)*') AS w FROM {source})
), {name}_kept AS (
  SELECT * FROM {name}_raw WHERE t NOT IN {_STOP} AND (length(t) > 1 OR regexp_full_match(t, '[0-9]'))
), {name} AS (
  SELECT {keys}, pos, 0 AS sub, t AS term FROM {name}_kept
  UNION ALL
  SELECT {keys}, pos, 1, s FROM (SELECT *, {stem} AS s FROM {name}_kept) WHERE s IS NOT NULL AND s NOT IN {_STOP}
)"""
