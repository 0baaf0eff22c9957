"""Typed statements as one wide table.

Every statement row has finding_id, id, ordinal, type, text, agent, rejected and
critic_notes; the other columns are null where they do not belong to the type.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import values as V

NOTE = "struct<action:string,reason:string,from_value:string,to_value:string,check_name:string>"
SCHEMA = {
    "finding_id": "string",
    "id": "string",
    "ordinal": "long",
    "type": "string",
    "text": "string",
    "agent": "string",
    "rejected": "boolean",
    "critic_notes": f"array<{NOTE}>",
    "source_kind": "string",
    "document_id": "string",
    "document_title": "string",
    "page_number": "long",
    "char_start": "long",
    "char_end": "long",
    "quote": "string",
    "text_was_repaired": "boolean",
    "page_quality": "string",
    "caveat": "string",
    "provider": "string",
    "endpoint": "string",
    "retrieved_at": "timestamp",
    "query": "map<string,string>",
    "licence": "string",
    "limitation": "string",
    "source_note": "string",
    "proxy_for": "string",
    "derived_from": "array<string>",
    "transformation": "string",
    "confidence": "string",
    "confidence_reason": "string",
    "falsified_by": "string",
    "why_needed": "string",
    "demoted_from": "string",
    "responds_to": "string",
    "priority": "int",
    "effort": "string",
    "who": "string",
}


def statement(df: DataFrame, kind_: str, made_by: str, /, **columns: Column | str) -> DataFrame:
    """Project rows into statements; ids come from content, so reruns agree.

    `df` has finding_id and ordinal; `columns` gives text and per-type fields.
    """
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    given.setdefault("type", F.lit(kind_))
    given.setdefault("agent", F.lit(made_by))
    given.setdefault("rejected", F.lit(False))
    given.setdefault("critic_notes", F.array())
    for key in ("finding_id", "ordinal"):
        given.setdefault(key, F.col(key))
    digest = F.sha2(F.concat_ws("|", given["finding_id"], given["agent"], given["type"], given["ordinal"], given["text"]), 256)
    given.setdefault("id", F.concat(F.lit("stm_"), F.left(digest, F.lit(12))))
    return df.select(
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SCHEMA.items()]
    )


def _filled(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))) > 0


def invariants() -> list[tuple[str, Column]]:
    """(rule, holds) for every construction rule of a statement."""
    kind, type_ = F.col("source_kind"), F.col("type")
    is_doc = kind == "document"
    return [
        ("text is not empty", _filled("text")),
        ("document source has a locator", ~is_doc | (F.col("page_number").isNotNull() & _filled("quote"))),
        ("dataset source has a locator", (kind != "dataset") | _filled("provider")),
        ("span end exceeds start", ~is_doc | (F.col("char_end") > F.col("char_start"))),
        ("page number is at least 1", ~is_doc | (F.col("page_number") >= 1)),
        ("fact is sourced", (type_ != "fact") | (kind.isNotNull() & (kind != "absent"))),
        (
            "inference has parents",
            (type_ != "inference") | (F.size(F.coalesce(F.col("derived_from"), F.array())) > 0),
        ),
        ("inference names its transformation", (type_ != "inference") | _filled("transformation")),
        ("inference says why it is so sure", (type_ != "inference") | _filled("confidence_reason")),
        ("assumption can be falsified", (type_ != "assumption") | _filled("falsified_by")),
        ("recommendation responds to something", (type_ != "recommendation") | _filled("responds_to")),
        (
            "priority is 1 to 5",
            (type_ != "recommendation") | F.coalesce(F.col("priority"), F.lit(3)).between(1, 5),
        ),
    ]


def broken_rules() -> Column:
    """Names of the construction rules a statement breaks."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in invariants()])
    )


def split_valid(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); nothing is dropped silently."""
    checked = statements.withColumn("broken_rules", broken_rules())
    return (
        checked.where(F.size("broken_rules") == 0).drop("broken_rules"),
        checked.where(F.size("broken_rules") > 0),
    )


def display_reference() -> Column:
    return F.coalesce(
        F.when(F.col("source_kind") == "document", F.format_string("%s, p. %d", "document_title", "page_number")),
        F.when(
            F.col("source_kind") == "dataset",
            F.concat("provider", F.coalesce(F.concat(F.lit(" ("), F.date_format("retrieved_at", "yyyy-MM-dd"), F.lit(")")), F.lit(""))),
        ),
        F.col("source_note"),
        F.lit("unsourced"),
    )


def source_caveat() -> Column:
    return F.when(F.col("source_kind") == "document", F.col("caveat")).when(
        F.col("source_kind") == "dataset", F.col("limitation")
    )


def confidence_rank(confidence: Column) -> Column:
    out = F
    for name, rank in V.CONFIDENCE_RANK.items():
        out = out.when(confidence == name, rank)
    return out.otherwise(0)


def note(action: str, reason: Column, check: str, from_value=None, to_value=None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        F.lit(action).alias("action"),
        reason.alias("reason"),
        (empty if from_value is None else from_value).cast("string").alias("from_value"),
        (empty if to_value is None else to_value).cast("string").alias("to_value"),
        F.lit(check).alias("check_name"),
    )


def reduce_confidence(statements: DataFrame, when: Column, to: str, reason: Column, check: str) -> DataFrame:
    """Lower confidence where `when` holds; confidence is never raised."""
    lower = (
        when
        & (F.col("type") == "inference")
        & (confidence_rank(F.col("confidence")) > V.CONFIDENCE_RANK[to])
    )
    added = note("reduce_confidence", reason, check, F.col("confidence"), F.lit(to))
    lower = F.coalesce(lower, F.lit(False))
    return statements.withColumn("_lower", lower).select(
        *[
            F.when(F.col("_lower"), F.array_append("critic_notes", added)).otherwise(F.col(c)).alias(c)
            if c == "critic_notes"
            else F.when(F.col("_lower"), to).otherwise(F.col(c)).alias(c)
            if c == "confidence"
            else F.col(c)
            for c in statements.columns
        ]
    )


def _pending() -> Column:
    """The first demotion recorded but not yet applied."""
    open_notes = F.filter(
        "critic_notes", lambda n: (n["action"] == "demote") & n["to_value"].isNull()
    )
    return F.try_element_at(open_notes, F.lit(1))


def apply_demotions(statements: DataFrame) -> DataFrame:
    """Carry out recorded demotions one level down, keeping id, text and trail."""
    marked = statements.withColumn("_note", _pending()).withColumn(
        "_move",
        F.when(F.col("_note").isNotNull() & F.col("type").isin("fact", "inference"), F.col("type")),
    )
    from_fact, from_inference = F.col("_move") == "fact", F.col("_move") == "inference"
    moved = F.col("_move").isNotNull()
    target = F.when(from_fact, "inference").when(from_inference, "assumption")
    reason = F.col("_note.reason")
    nothing = F.lit(None)
    changes = {
        "critic_notes": F.when(
            moved,
            F.array_append(
                "critic_notes", note("demote", reason, "applied", F.col("_move"), target)
            ),
        ),
        "type": target,
        "agent": F.when(moved, "critic"),
        "rejected": F.when(moved, False),
        "derived_from": F.when(from_fact, F.array("id")),
        "transformation": F.when(
            from_fact,
            F.format_string(
                "Originally asserted as a fact sourced to %s; demoted by the critic.", display_reference()
            ),
        ),
        "confidence": F.when(from_fact, "low"),
        "confidence_reason": F.when(from_fact, reason),
        "falsified_by": F.when(from_inference, reason),
        "why_needed": F.when(
            from_inference, "Retained after demotion so the original claim remains auditable."
        ),
        "demoted_from": F.when(from_inference, "inference"),
    }
    kept_when_moved = {"finding_id", "id", "ordinal", "text"}
    out = []
    for name in statements.columns:
        if name in changes:
            value = F.when(moved, changes[name].cast(SCHEMA[name])).otherwise(F.col(name))
        elif name in kept_when_moved or name not in SCHEMA:
            value = F.col(name)
        else:
            value = F.when(moved, nothing.cast(SCHEMA[name])).otherwise(F.col(name))
        out.append(value.alias(name))
    return marked.select(*out)


def flattened(statements: DataFrame) -> DataFrame:
    """Statements as they are shown: each type with its own fields, sources under one roof.

    A fact from a document has a `citation`, one from a data set its provider, date and
    limitation, which stays with the number it qualifies; fields of other types are null.
    """
    is_type = lambda name: F.col("type") == name
    only = lambda name, *columns: [F.when(is_type(name), F.col(c)).alias(c) for c in columns]
    cited = is_type("fact") & (F.col("source_kind") == "document")
    measured = is_type("fact") & (F.col("source_kind") == "dataset")
    citation = F.struct(
        "document_id", "document_title", "page_number", "char_start", "char_end", "quote",
        (~F.coalesce("text_was_repaired", F.lit(False))).alias("is_verbatim"), "text_was_repaired", "page_quality", "caveat",
        display_reference().alias("reference"),
    )
    return statements.select(
        "finding_id", "ordinal", "id", "type", "text", "agent", (F.size("critic_notes") > 0).alias("was_weakened"), "rejected",
        F.transform("critic_notes", lambda n: F.struct(n["action"].alias("action"), n["reason"].alias("reason"), n["from_value"].alias("from"), n["to_value"].alias("to"))).alias("critic_notes"),
        F.when(cited, citation).alias("citation"),
        *only("fact", "proxy_for"),
        *[F.when(measured, F.col(c)).alias(f"dataset_{c}") for c in ("provider", "retrieved_at", "limitation")],
        *only("inference", "derived_from", "transformation", "confidence", "confidence_reason"),
        *only("assumption", "falsified_by", "why_needed", "demoted_from"),
        *only("recommendation", "responds_to", "priority", "who"),
    )


def type_summary(statements: DataFrame, by: list[str]) -> DataFrame:
    """Zero-filled counts by type without rejected ones, plus rejected and weakened."""
    kept = ~F.col("rejected")
    return statements.groupBy(*by).agg(
        *[F.count_if(kept & (F.col("type") == t)).alias(t) for t in V.STATEMENT_TYPES],
        F.count_if("rejected").alias("rejected"),
        F.count_if(F.size("critic_notes") > 0).alias("weakened_by_critic"),
    )
