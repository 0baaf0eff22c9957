"""Typed statements made from documents, some of them breaking a rule on purpose."""

from pyspark.sql import functions as F

from lacuna.functions import text as X
from lacuna.operators import critic as C
from lacuna.operators import statements as S
from lacuna.sources.tables import read_table
from lacuna.workload.standins import finish


def made(spark, sf_dir):
    """Every document as a statement; its length decides what is wrong with it."""
    docs = read_table(spark, sf_dir, "documents", spread=True)
    labels = read_table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    k, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda by, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    text = F.concat(
        F.col("text"),
        F.when(n % 9 == 0, " Building here is permitted.").otherwise(""),
        F.when(n % 7 == 0, " Good accessibility.").otherwise(""),
    )
    half = F.floor(n / 2).cast("int")
    d = d.select(
        F.col("source").alias("finding_id"),
        k.alias("ordinal"),
        text.alias("_text"),
        F.when(F.coalesce("quality", F.lit(0)) == 1, F.col("text")).otherwise(F.left("text", half)).alias("_quote"),
        k.alias("k"), n.alias("n"),
    )
    k, n = F.col("k"), F.col("n")
    return S.statement(
        d, "", "",
        id=F.concat(F.lit("stm_"), k.cast("string")),
        type=pick(k, "fact", "inference", "assumption", "recommendation"),
        agent=pick(F.floor(k / 4), "site", "regulation"),
        text=F.col("_text"),
        source_kind=F.when(k % 4 == 0, pick(F.floor(k / 4), "document", "dataset", "absent")),
        document_title="Plan",
        page_number=k % 7,
        char_start=F.lit(10),
        char_end=10 + n % 5,
        quote=F.col("_quote"),
        provider=F.when(n % 6 != 0, "survey"),
        retrieved_at=F.lit("2024-05-01").cast("timestamp"),
        caveat=F.when(n % 2 == 0, "Read with care."),
        limitation="Coarse grid.",
        proxy_for=F.when(k % 3 == 0, "access"),
        derived_from=F.when(n % 8 == 0, F.array()).otherwise(F.array(F.concat(F.lit("stm_"), (k - 1).cast("string")))),
        transformation=F.when(n % 13 == 0, "").otherwise("Compared."),
        confidence=pick(k, "high", "medium", "low"),
        confidence_reason=F.when(n % 11 == 0, "").otherwise("Observed."),
        falsified_by=F.when(n % 10 == 0, "").otherwise("A survey."),
        responds_to=F.when(n % 12 == 0, "").otherwise("A gap."),
        priority=k % 7,
    )


MADE = """made AS (
  SELECT source AS finding_id, doc_id AS ordinal, 'stm_' || doc_id AS id, n_chars AS n, doc_id AS k,
    ['fact', 'inference', 'assumption', 'recommendation'][doc_id % 4 + 1] AS type,
    ['site', 'regulation'][(doc_id // 4) % 2 + 1] AS agent,
    text || CASE WHEN n_chars % 9 = 0 THEN ' Building here is permitted.' ELSE '' END || CASE WHEN n_chars % 7 = 0 THEN ' Good accessibility.' ELSE '' END AS text,
    CASE WHEN doc_id % 4 = 0 THEN ['document', 'dataset', 'absent'][(doc_id // 4) % 3 + 1] END AS source_kind,
    CASE WHEN coalesce(quality, 0) = 1 THEN text ELSE left(text, n_chars // 2) END AS quote,
    CASE WHEN doc_id % 3 = 0 THEN 'access' END AS proxy_for,
    ['high', 'medium', 'low'][doc_id % 3 + 1] AS confidence
  FROM documents LEFT JOIN labels USING (doc_id))"""


def flags(spark, sf_dir):
    """What is known of each finding's evidence, from its documents."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("finding_id")).agg(
        F.bool_or(F.col("n_chars") < 60).alias("has_blind_spots"),
        F.bool_or(F.col("n_chars") % 200 == 0).alias("has_risky_tables"),
    )


FLAGS = """flags AS (SELECT source AS finding_id, bool_or(n_chars < 60) AS b, bool_or(n_chars % 200 = 0) AS r FROM documents GROUP BY 1)"""


def reviewed(spark, sf_dir):
    return C.review(made(spark, sf_dir), flags(spark, sf_dir))


def words_sql(text: str) -> str:
    from lacuna.workload.standins import STOP_SQL

    return (f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9.]+'), "
            f"lambda w: length(w) > 2 AND w NOT IN {STOP_SQL}))")


OVERLAP = "CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, qw)) / len(cw)::DOUBLE END"
_CLAIM = r"(?i)\b(complies?|compliant|is permitted|is allowed|you can build|guarantee[sd]?|certainly|definitely|will be approved|no restrictions?|fully satisfies)\b"
_INTERPRET = r"(?i)\baccessib|\bconnectivit|\bsuitab|\bdesirab|\battractiv|\bwell[- ]served\b"
NOTES = f"""{MADE}, {FLAGS}, worded AS (
  SELECT *, {words_sql('text')} AS cw, {words_sql('quote')} AS qw FROM made
), judged AS (
  SELECT m.*, {OVERLAP} AS overlap, nullif(regexp_extract(text, '{_CLAIM}'), '') AS phrase, coalesce(b OR r, false) AS weak, b, r,
    type = 'fact' AND source_kind = 'absent' AS n_sourced,
    type = 'fact' AND regexp_matches(text, '{_INTERPRET}') AND proxy_for IS NULL AS n_proxied
  FROM worded m LEFT JOIN flags USING (finding_id)
), noted AS (
  SELECT *, coalesce(type = 'fact' AND source_kind = 'document' AND overlap < 0.55, false) AS n_quoted,
    type = 'inference' AND confidence IN ('high', 'medium') AND weak AS n_capped, phrase IS NOT NULL AS n_over FROM judged)"""


def invariant_violations(spark, sf_dir):
    broken = made(spark, sf_dir).select("id", S.broken_rules().alias("r"))
    return X.unnest(broken, "r", "rule").select("id", "rule")


_RULES = [
    ("span end exceeds start", "source_kind = 'document' AND n % 5 = 0"),
    ("page number is at least 1", "source_kind = 'document' AND k % 7 = 0"),
    ("document source has a locator", "source_kind = 'document' AND quote = ''"),
    ("dataset source has a locator", "source_kind = 'dataset' AND n % 6 = 0"),
    ("fact is sourced", "type = 'fact' AND source_kind = 'absent'"),
    ("inference has parents", "type = 'inference' AND n % 8 = 0"),
    ("inference names its transformation", "type = 'inference' AND n % 13 = 0"),
    ("inference says why it is so sure", "type = 'inference' AND n % 11 = 0"),
    ("assumption can be falsified", "type = 'assumption' AND n % 10 = 0"),
    ("recommendation responds to something", "type = 'recommendation' AND n % 12 = 0"),
    ("priority is 1 to 5", "type = 'recommendation' AND k % 7 NOT BETWEEN 1 AND 5"),
]
_BROKEN = f"WITH {MADE} " + " UNION ALL ".join(f"SELECT id, '{r}' AS rule FROM made WHERE {w}" for r, w in _RULES)


def references(spark, sf_dir):
    return made(spark, sf_dir).select("id", S.display_reference().alias("reference"), S.source_caveat().alias("caveat"))


_REFS = f"""WITH {MADE} SELECT id, CASE WHEN source_kind = 'document' THEN 'Plan, p. ' || (k % 7)
  WHEN source_kind = 'dataset' AND n % 6 <> 0 THEN 'survey (2024-05-01)' WHEN source_kind = 'dataset' THEN 'unsourced' ELSE 'unsourced' END AS reference,
  CASE WHEN source_kind = 'document' AND n % 2 = 0 THEN 'Read with care.' WHEN source_kind = 'dataset' THEN 'Coarse grid.' END AS caveat FROM made"""


def demotions(spark, sf_dir):
    done = S.apply_demotions(reviewed(spark, sf_dir))
    return finish(done.select("id", "type", "agent", "confidence", "demoted_from", "rejected",
                              F.size("critic_notes").alias("n_notes"), F.array_join("derived_from", ",").alias("derived_from")))


_DEMOTED = f"""WITH {NOTES}, d AS (SELECT *, n_quoted OR n_proxied AS moved FROM noted)
SELECT id, CASE WHEN moved THEN 'inference' ELSE type END AS type, CASE WHEN moved THEN 'critic' ELSE agent END AS agent,
  CASE WHEN moved OR n_capped THEN 'low' ELSE confidence END AS confidence, NULL::VARCHAR AS demoted_from,
  CASE WHEN moved THEN false ELSE n_sourced END AS rejected,
  n_sourced::BIGINT + n_quoted::BIGINT + n_proxied::BIGINT + n_capped::BIGINT + n_over::BIGINT + moved::BIGINT AS n_notes,
  CASE WHEN moved THEN id WHEN n % 8 = 0 THEN '' ELSE 'stm_' || (k - 1) END AS derived_from
FROM d"""


def double_demotions(spark, sf_dir):
    """Inferences marked for demotion become assumptions, whatever their text."""
    m = made(spark, sf_dir)
    mark = S.note("demote", F.lit("The derivation no longer holds."), "applied", F.col("type"))
    marked = m.withColumn("critic_notes", F.when(F.col("type") == "inference", F.array(mark)).otherwise(F.col("critic_notes")))
    done = S.apply_demotions(marked)
    return finish(done.groupBy("finding_id", "type", "agent", "demoted_from", "falsified_by").agg(F.count(F.lit(1)).alias("n")))


_DOUBLE = f"""WITH {MADE} SELECT finding_id, CASE WHEN type = 'inference' THEN 'assumption' ELSE type END AS type,
  CASE WHEN type = 'inference' THEN 'critic' ELSE agent END AS agent, CASE WHEN type = 'inference' THEN 'inference' END AS demoted_from,
  CASE WHEN type = 'inference' THEN 'The derivation no longer holds.' WHEN n % 10 = 0 THEN '' ELSE 'A survey.' END AS falsified_by, count(*) AS n
FROM made GROUP BY ALL"""


def flat_statements(spark, sf_dir):
    """Reviewed statements as they are shown, sources and notes in columns of their own."""
    f = S.flattened(reviewed(spark, sf_dir))
    return finish(f.select("id", "type", "was_weakened", "rejected", F.size("critic_notes").alias("n_notes"), "citation.reference", "citation.is_verbatim",
                           "proxy_for", "dataset_provider", "dataset_limitation", "confidence", "falsified_by", "responds_to", "priority"))


_FLAT = f"""WITH {NOTES} SELECT id, type, n_sourced OR n_quoted OR n_proxied OR n_capped OR n_over AS was_weakened, n_sourced AS rejected,
  n_sourced::BIGINT + n_quoted::BIGINT + n_proxied::BIGINT + n_capped::BIGINT + n_over::BIGINT AS n_notes,
  CASE WHEN source_kind = 'document' THEN 'Plan, p. ' || (k % 7) END AS reference, CASE WHEN source_kind = 'document' THEN true END AS is_verbatim,
  CASE WHEN type = 'fact' THEN proxy_for END AS proxy_for, CASE WHEN source_kind = 'dataset' AND n % 6 <> 0 THEN 'survey' END AS dataset_provider,
  CASE WHEN source_kind = 'dataset' THEN 'Coarse grid.' END AS dataset_limitation,
  CASE WHEN type = 'inference' THEN CASE WHEN n_capped THEN 'low' ELSE confidence END END AS confidence,
  CASE WHEN type = 'assumption' THEN CASE WHEN n % 10 = 0 THEN '' ELSE 'A survey.' END END AS falsified_by,
  CASE WHEN type = 'recommendation' THEN CASE WHEN n % 12 = 0 THEN '' ELSE 'A gap.' END END AS responds_to, CASE WHEN type = 'recommendation' THEN k % 7 END AS priority
FROM noted"""


def type_summary(spark, sf_dir):
    return S.type_summary(reviewed(spark, sf_dir), ["finding_id"])


_SUMMARY = f"""WITH {NOTES} SELECT finding_id, {", ".join(f"count(*) FILTER (NOT n_sourced AND type = '{t}') AS {t}" for t in ("fact", "inference", "assumption", "recommendation"))},
  count(*) FILTER (n_sourced) AS rejected, count(*) FILTER (n_sourced OR n_quoted OR n_proxied OR n_capped OR n_over) AS weakened_by_critic
FROM noted GROUP BY finding_id"""

QUERIES = {
    "invariant_violations": (invariant_violations, _BROKEN),
    "references": (references, _REFS),
    "demotions": (demotions, _DEMOTED),
    "inference_demotions": (double_demotions, _DOUBLE),
    "flat_statements": (flat_statements, _FLAT),
    "type_summary": (type_summary, _SUMMARY),
}
