"""Secret scans with corpus-wide ownership of what was found.

Candidates are found in whole texts, and from then on known by a digest of their
value.  Counting the distinct owners and repositories of each digest over the whole
corpus separates examples that everybody copies from values of one owner, which
look live.  Base kinds are reported wherever they match; the kinds this operator
adds are reported only where the value looks live.

Null texts count as empty.  A very long text is scanned whole, in memory in
proportion to its length; an empty table gives an empty result; spans are ordered by
start, then kind, so there are no ties.  A null owner or repository counts as one of its own.
Repeated rows are scanned each.  Of other columns only those named as owner and
repository are read.  Positions are code points, ends exclusive.
"""

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read, stored, whole_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds that are always reported, then those reported where they look live.
BASE = ["assign", "access", "hex"]
ADDED = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*"),
    "prefixed": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    "web_token": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    "login": re.compile(r"://[^\s:/@]+:([^\s:/@]{6,})@"),
    "mixed": re.compile(r"[A-Za-z0-9+/_-]{32,}"),
}
#: Cheap tests that a text has to pass before the pattern is tried.
_HINT = {"private_key": "-----BEGIN ", "prefixed": "_", "web_token": "eyJ", "login": "://"}
KINDS = [*BASE, *ADDED]
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|\*\*\*|<|(.)\1{7}", re.A)
#: A value known to more owners than this is a copied example.
MAX_OWNERS = 2

FOUND = "array<struct<kind string, start int, end int, value_start int, value string, odd boolean>>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in (value.count(x) for x in set(value)))


def _random_looking(value: str) -> bool:
    mixed = re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)
    return bool(mixed) and entropy(value) >= 4


def find(text: str | None) -> list[tuple]:
    """(kind, start, end, start of the value, digest of the value, placeholder) of all candidates, in order."""
    text = text or ""
    found = []
    add = lambda kind, m, g: found.append((m.start(), KINDS.index(kind), m.end(), m.start(g), m[g]))
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", m, 2)
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            add(kind, m, 0)
    covered = [(s, e) for s, _, e, _, _ in found]
    for kind, pattern in ADDED.items():
        if _HINT.get(kind, "") in text:
            for m in pattern.finditer(text):
                group = pattern.groups
                if kind == "mixed" and (not _random_looking(m[0]) or any(s < m.end() and m.start() < e for s, e in covered)):
                    continue
                add(kind, m, group)
    found.sort()
    return [
        (KINDS[k], s, e, vs, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], bool(PLACEHOLDER.search(v)))
        for s, k, e, vs, v in found
    ]


def scan(docs: DataFrame, owner: Column, repository: Column, keep: list[str]) -> DataFrame:
    """A stored row per document: the columns to keep, owner, repository, and candidates.

    The row number is taken once and stored with the row, so it is stable.
    """

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "value_start", "value", "odd")
        for texts in batches:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in find(t)] for t in texts], dtype=object)

    found = F.pandas_udf(search, FOUND)(F.col("text"))
    rows = docs.select(
        F.struct(*keep).alias("doc"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), found.alias("found"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "secret-scan")


def ownership(rows: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value.

    Duplicates go in the first, partial step, so a value in a third of all rows is
    a row per owner and repository before anything is counted.
    """
    each = rows.select("owner", "repository", F.explode("found.value").alias("value")).distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged(rows: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """row and `spans`, all its candidates in order, each with n_owners, n_repositories and `live`."""
    each = rows.select("row", F.posexplode("found").alias("at", "c"))
    live = (F.col("n_owners") <= max_owners) & ~F.col("c.odd")
    return (
        each.withColumn("value", F.col("c.value"))
        .join(ownership(rows), "value")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct(
            "at", "c.kind", "c.start", "c.end", "c.value_start", "n_owners", "n_repositories", live.alias("live")))).alias("spans"))
    )


def redact(docs: DataFrame, owner: Column, repository: Column, mark: str = "[secret]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The same documents; values that look live are replaced by a mark.

    Documents without candidates pass as they are, unshuffled.
    """

    def replace(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            parts, at = [], 0
            for s in found:
                if s["live"] and s["end"] > at:
                    parts += [t[at : max(at, s["value_start"])], mark if s["value_start"] >= at else ""]
                    at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    rows = scan(docs, owner, repository, docs.columns)
    changed = F.pandas_udf(replace, "string")(F.col("doc.text"), F.col("spans"))
    hit = rows.where(F.size("found") > 0)
    hit = hit.join(judged(hit, max_owners), "row").select("doc", changed.alias("clean"))
    clean = rows.where(F.size("found") == 0).select("doc", F.col("doc.text").alias("clean"))
    columns = [F.col("clean").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    return clean.unionAll(hit).select(*columns)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def source_owner() -> tuple[Column, Column]:
    """In `documents` a source is an owner, and what it has in a language a repository."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"), *source_owner(), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    number = lambda what: F.coalesce(F.size(F.filter("spans", what)), F.lit(0)).cast("long")
    return rows.join(judged(rows), "row", "left").select(
        "doc.doc_id", *(count(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
        F.coalesce(_joined(F.filter("spans", lambda s: s["kind"].isin(BASE) | s["live"])), F.lit("")).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_copied"),
    )


QUERIES = {"op3_secret_scans": (op3_secret_scans, None)}
