"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one bit per failed rule; a policy is a versioned mask of the rules that reject.
Changing a policy, or asking what a rule alone does, reads the ledger and never the
texts.

Null and empty texts have no words and fail the first rule.  A very long text is measured whole, in memory in
proportion to its length; an empty table gives an empty ledger; a verdict looks at one
document, so there are no ties.  Repeated rows give a
ledger row each.  Only `doc_id` and `text` are read, so other columns may have any
name.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]

#: Rules in the order of their bits; a rule's bit never changes.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_upper > n_lower",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE_RULES = ["few_words", "repeated_words"]
#: Policies: name, version, rejecting rules.
POLICIES = [("base", 1, BASE_RULES), ("strict", 1, list(RULES))]


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: list[str]) -> int:
    return sum(bit(r) for r in set(rules))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    raw = text.encode("utf-8", "surrogatepass")
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    repeat = to = 0
    if len(found) < len(windows):
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeat += i + 3 - max(i, to)
                to = i + 3
    n_lines = sum(lines.values())
    return (
        len(words), sum(map(len, words)), len(raw) - len(raw.translate(None, SYMBOLS)), n_lines - len(lines), repeat, n_lines,
        len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, LOWER)),
    )


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`, a bit for each rule."""
    measured = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    failed = " | ".join(f"if({rule}, {bit(name)}L, 0L)" for name, rule in RULES.items())
    return (
        docs.select("doc_id", measured("text").alias("m"))
        .select("doc_id", "m.*")
        .withColumn("failed", F.expr(failed))
    )


def apply_policy(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Add `kept`, and `only_rule` where a single rule of the policy rejects."""
    hit = F.col("failed").bitwiseAND(F.lit(mask(rules)))
    only = F.coalesce(*(F.when(hit == bit(r), F.lit(r)) for r in rules))
    return rows.withColumns({"kept": hit == 0, "only_rule": only})


def ablation(rows: DataFrame, policies: list[tuple[str, int, list[str]]] = POLICIES) -> DataFrame:
    """What each rule does in each policy, from counts of failure patterns alone.

    documents: all; rejected: by the policy; fails: the rule's own failures;
    only: rejected by no other rule, so kept if the rule were left out.
    The ledger is first reduced to one row per pattern of bits, at most 2 ** rules.
    """
    choices = [
        F.struct(*(F.lit(v).alias(k) for k, v in (("policy", n), ("policy_version", version), ("rule", r), ("reject", mask(rules)), ("bit", bit(r)))))
        for n, version, rules in policies for r in rules
    ]
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    each = patterns.select("failed", "n", F.inline(F.array(*choices)))
    count = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0))
    return each.groupBy("policy", "policy_version", "rule").agg(
        F.sum("n").alias("documents"), count("failed & reject != 0").alias("rejected"),
        count("failed & bit != 0").alias("fails"), count("failed & reject = bit").alias("only"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(read(spark, sf_dir, "documents")), list(RULES))
    return judged.select(
        "doc_id", *MEASURES[:5], (F.col("failed").bitwiseAND(F.lit(mask(BASE_RULES))) != 0).alias("base_failed"), "kept",
        "n_lines", "n_upper", "n_lower", "failed", "only_rule",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(3) t(j) WHERE c > 1 GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS s FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT s) AS dup FROM line
          WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items()) + r""" AS fb FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fb & """ + str(mask(BASE_RULES)) + r""" <> 0 AS base_failed,
  fb = 0 AS kept, n_lines, n_upper, n_lower, fb::BIGINT AS failed,
  CASE fb """ + " ".join(f"WHEN {bit(r)} THEN '{r}'" for r in RULES) + r""" END AS only_rule
FROM f
"""

QUERIES = {"op1_quality_rules": (op1_quality_rules, SQL)}
