"""Generated text at the edge of the engine: prompts out, replies in.

No model is called here.  The prompt of a finding is built from its passages; a
caller that has a model returns a reply, and without one every finding gets an
explicit refusal instead of an empty answer.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import text as X
from lacuna.operators.statements import statement

REFUSAL = "No language model is configured; claims are verbatim passages and no prose is generated."


def passages(evidence: DataFrame) -> DataFrame:
    """Numbered passages per question, each with its reliability caveat (at most k meet here)."""
    caveat = F.when(F.size("caveats") > 0, F.concat(F.lit("\n   RELIABILITY: "), F.array_join("caveats", " "))).otherwise("")
    line = F.concat(F.format_string("[%d] (%s) %s", "rank", "citation_label", "quote"), caveat)
    return evidence.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda p: p["t"]), "\n").alias("passages")
    )


def prompts(questions: DataFrame, evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """One prompt per question with evidence; what could not be read is said in it."""
    gap = F.coalesce(F.concat(F.lit("\n\nNOT READABLE: "), F.col("coverage_note")), F.lit(""))
    return (
        questions.join(passages(evidence), "query_id")
        .join(notes, "query_id", "left")
        .select("query_id", F.concat(F.lit("QUESTION: "), "question", F.lit("\n\nPASSAGES:\n"), "passages", gap).alias("prompt"))
    )


def refusals(questions: DataFrame) -> DataFrame:
    """The reply of no model: not ok, with the reason."""
    return questions.select(
        "query_id", F.lit("").alias("text"), F.lit(False).alias("ok"), F.lit(REFUSAL).alias("error")
    )


def reply_json(reply: Column) -> Column:
    """The JSON of a reply, with or without a code fence around it or prose beside it."""
    body = X.strip(reply)
    inside = F.regexp_replace(F.regexp_extract(body, r"(?s)\A```(.*?)(?:```|\z)", 1), rf"\A{X.SPACE}*json", "")
    text = X.strip(F.when(F.startswith(body, F.lit("```")), inside).otherwise(body))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(braces, F.lit(""))))


def review_findings(replies: DataFrame) -> DataFrame:
    """Problems a reviewing model reported; an unreadable reply reports none.

    replies(finding_id, text) holds {"findings": [{"problem", "severity"}, ...]}.
    """
    shape = "array<struct<problem:string,severity:string>>"
    parsed = replies.select(
        "finding_id",
        F.from_json(F.to_json(F.try_variant_get(reply_json(F.col("text")), "$.findings", "variant")), shape).alias("f"),
    )
    rows = X.unnest(parsed, "f", "p", "position")
    high = F.lower(F.coalesce("p.severity", F.lit("medium"))) == "high"
    return rows.select(
        "finding_id", "position", X.strip(F.col("p.problem")).alias("reason"),
        F.when(high, "flag_misleading").otherwise("require_verification").alias("action"),
    ).where(F.length("reason") > 0)


def synthesis_statements(replies: DataFrame, claims: DataFrame) -> DataFrame:
    """Generated prose as an inference from the claims it was given.

    replies(finding_id, text, ok); claims hold at most k rows per finding.
    """
    parents = claims.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("c"))
    return statement(
        replies.where("ok").join(parents, "finding_id").withColumn("ordinal", F.lit(350)), "inference", "regulation",
        text=F.col("text"),
        derived_from=F.transform("c", lambda c: c["id"]),
        transformation="Summarised by a language model from the quoted passages only.",
        confidence="medium",
        confidence_reason="Generated from retrieved passages; wording is the model's own.",
    )
