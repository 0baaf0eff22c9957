"""The critic's checks over the made statements and over conversations."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.functions import tokens as T
from lacuna.operators import critic as C
from lacuna.operators import generated as G
from lacuna.sources.tables import read_table
from lacuna.workload.standins import filled_sql, finish, sql_text
from lacuna.workload.statements import NOTES, OVERLAP, made, reviewed, words_sql


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations", spread=True)


def content_words(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", T.content_words("text").alias("w"))
    flat = X.unnest(docs, "w", "word")
    return flat.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


def quote_overlap(spark, sf_dir):
    """Each answer against the turn before it."""
    t = _turns(spark, sf_dir)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("quote"))
    pairs = t.where(F.col("role") == "assistant").join(before, ["conv_id", "turn"])
    share = T.overlap(T.content_words("text"), T.content_words("quote"))
    return pairs.select("conv_id", "turn", F.round(share, 4).alias("overlap"), (share < V.MIN_LEXICAL_SUPPORT).alias("unsupported"))


_QUOTE = f"""WITH w AS (SELECT a.conv_id, a.turn, {words_sql('a.text')} AS cw, {words_sql('b.text')} AS qw
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, round({OVERLAP}, 4) AS overlap, {OVERLAP} < 0.55 AS unsupported FROM w"""


def proxy_check(spark, sf_dir):
    return made(spark, sf_dir).where((F.col("type") == "fact") & C.undeclared_proxy()).select("id", "finding_id")


def overclaims(spark, sf_dir):
    found = made(spark, sf_dir).select("id", C.overclaim_phrase(F.col("text")).alias("phrase"))
    return found.where(F.col("phrase").isNotNull())


def confidence_cap(spark, sf_dir):
    return C.findings(reviewed(spark, sf_dir)).where(F.col("action") == "reduce_confidence").select("statement_id", "reason")


_CAP_PARTS = f"""array_to_string(list_filter([CASE WHEN b THEN {sql_text(C.WORDING["capped_blind"])} END,
    CASE WHEN r THEN {sql_text(C.WORDING["capped_tables"])} END], lambda x: x IS NOT NULL), ' and ')"""
_CAP = f"""WITH {NOTES} SELECT id AS statement_id, {filled_sql(C.WORDING["capped"], parts=_CAP_PARTS)} AS reason
FROM noted WHERE n_capped"""


def _spoken(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("finding_id"), F.col("turn").alias("id"), "role", "text")
    return t.where(F.col("role") == "assistant"), t.where(F.col("role") == "user")


def sentence_support(spark, sf_dir):
    said, known = _spoken(spark, sf_dir)
    return finish(C.sentence_support(said, known).select("finding_id", "id", "sentence_no", "words", "supported_words", "supported"))


def grounding(spark, sf_dir):
    said, known = _spoken(spark, sf_dir)
    return finish(C.ungrounded(C.sentence_support(said, known)))


def verification_rows(spark, sf_dir):
    """The sentences of answers that the questions' words do not carry, one by one."""
    said, known = _spoken(spark, sf_dir)
    return finish(C.verification_rows(C.sentence_support(said, known), said))


_SUPPORT = rf"""sentences AS (
  SELECT conv_id AS finding_id, turn AS id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations WHERE role = 'assistant')
), words AS (SELECT finding_id, id, sentence_no, {words_sql('sentence')} AS w FROM sentences
), known AS (SELECT DISTINCT conv_id AS finding_id, unnest({words_sql('text')}) AS word FROM conversations WHERE role = 'user'
), said AS (SELECT finding_id, id, sentence_no, len(w) AS words, unnest(w) AS word FROM words WHERE len(w) >= 4
), support AS (SELECT s.finding_id, id, sentence_no, words, count(k.word) AS supported_words, count(k.word) / words >= 0.55 AS supported
  FROM said s LEFT JOIN known k ON k.finding_id = s.finding_id AND k.word = s.word GROUP BY s.finding_id, id, sentence_no, words)"""


def _answers(spark, sf_dir):
    """Every assistant's turn as a generated answer to the user's turn before it."""
    t = _turns(spark, sf_dir)
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("finding_id")
    replies = t.where(F.col("role") == "assistant").select(key(F.col("turn")), "text", F.lit(True).alias("ok"))
    claims = t.where(F.col("role") == "user").select(key(F.col("turn") + 1), F.col("turn").alias("ordinal"), F.concat(F.lit("claim_"), F.col("turn").cast("string")).alias("id"), "text")
    return G.synthesis_statements(replies, claims), claims


def generated_answers(spark, sf_dir):
    """Answers as inferences from what was asked, less sure where sentences are not carried by it."""
    made, claims = _answers(spark, sf_dir)
    bad = C.ungrounded(C.sentence_support(made, claims))
    capped = C.cap_ungrounded(made, bad)
    return finish(capped.select("finding_id", "type", "text", F.array_join("derived_from", ",").alias("derived_from"), "confidence",
                                F.size("critic_notes").alias("n_notes"), F.get("critic_notes", F.lit(0))["reason"].alias("reason")))


_ANSWERS = rf"""WITH paired AS (
  SELECT a.conv_id || ':' || a.turn AS finding_id, a.text, u.text AS asked, 'claim_' || u.turn AS parent
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'
), sentences AS (
  SELECT finding_id, asked, generate_subscripts(s, 1) AS k, unnest(s) AS sentence FROM (
    SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM paired)
), worded AS (SELECT finding_id, {words_sql('sentence')} AS cw, {words_sql('asked')} AS qw FROM sentences
), bad AS (SELECT finding_id, count(*) AS n FROM worded WHERE len(cw) >= 4 AND len(list_intersect(cw, qw)) / len(cw)::DOUBLE < 0.55 GROUP BY 1)
SELECT finding_id, 'inference' AS type, text, parent AS derived_from, CASE WHEN n > 0 THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN n > 0 THEN 1 ELSE 0 END::BIGINT AS n_notes, CASE WHEN n > 0 THEN {filled_sql(C.WORDING["grounded"], n="n")} END AS reason
FROM paired LEFT JOIN bad USING (finding_id)"""


def findings_by_action(spark, sf_dir):
    return C.by_action(C.findings(reviewed(spark, sf_dir)))


_FOUND = f"""{NOTES}, found AS (
  SELECT finding_id, id, 'reject' AS action, '{V.CHECK_NAMES["sourced"]}' AS check_name FROM noted WHERE n_sourced
  UNION ALL SELECT finding_id, id, 'demote', '{V.CHECK_NAMES["quoted"]}' FROM noted WHERE n_quoted
  UNION ALL SELECT finding_id, id, 'demote', '{V.CHECK_NAMES["proxied"]}' FROM noted WHERE n_proxied
  UNION ALL SELECT finding_id, id, 'reduce_confidence', '{V.CHECK_NAMES["capped"]}' FROM noted WHERE n_capped
  UNION ALL SELECT finding_id, id, 'flag_misleading', '{V.CHECK_NAMES["overclaimed"]}' FROM noted WHERE n_over)"""


def checks_with_findings(spark, sf_dir):
    return finish(C.checks_with_findings(C.findings(reviewed(spark, sf_dir))).drop("check_order"))


_RAN = "(VALUES " + ", ".join(f"('{n}')" for k, n in V.CHECKS if k != "grounded") + ") AS c(check_name)"

QUERIES = {
    "content_words": (content_words, f"SELECT word, count(*) AS documents FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY 1"),
    "quote_overlap": (quote_overlap, _QUOTE),
    "proxy_check": (proxy_check, f"WITH {NOTES} SELECT id, finding_id FROM noted WHERE n_proxied"),
    "overclaims": (overclaims, f"WITH {NOTES} SELECT id, phrase FROM noted WHERE n_over"),
    "confidence_cap": (confidence_cap, _CAP),
    "sentence_support": (sentence_support, f"WITH {_SUPPORT} SELECT * FROM support"),
    "grounding": (grounding, f"""WITH {_SUPPORT} SELECT finding_id, id, count(*) FILTER (NOT supported) AS unsupported_sentences,
  min(sentence_no) FILTER (NOT supported) AS first_unsupported FROM support GROUP BY ALL HAVING count(*) FILTER (NOT supported) > 0"""),
    "verification_rows": (verification_rows, f"""WITH {_SUPPORT} SELECT finding_id, id AS statement_id, 'require_verification' AS action, sentence_no, sentence
  FROM support JOIN sentences USING (finding_id, id, sentence_no) WHERE NOT supported"""),
    "generated_answers": (generated_answers, _ANSWERS),
    "findings_by_action": (findings_by_action, f"WITH {_FOUND} SELECT finding_id, action, count(*) AS n FROM found GROUP BY ALL"),
    "checks_with_findings": (checks_with_findings, f"WITH {_FOUND} SELECT c.check_name, count(f.id) AS n FROM {_RAN} LEFT JOIN found f USING (check_name) GROUP BY 1"),
}
