"""A finding per question: site and document side joined, reviewed and counted."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.operators import assembly, conflicts, critic, reports, search
from lacuna.operators.statements import apply_demotions, split_valid
from lacuna.plans import ask
from lacuna.session import materialise


@dataclass
class Findings:
    """Lazy parts of all findings, keyed by finding_id (the question's id as text)."""

    statements: DataFrame
    quarantined: DataFrame
    conflicts: DataFrame
    blind_spots: DataFrame
    critic_findings: DataFrame
    coverage: DataFrame
    evidence: DataFrame


def analyse(
    chunked: DataFrame,
    questions: DataFrame,
    site_statements: DataFrame,
    nearest: DataFrame,
    document_title: str,
    water_rule: dict,
    k: int = V.AGENT_TOP_K,
) -> Findings:
    """Answer questions and set them against what was measured at each place.

    site_statements and nearest(finding_id, category, label, distance_m) are keyed
    by the question's id as text.
    """
    found = ask.answer(chunked, questions, k)
    keyed = F.col("query_id").cast("string").alias("finding_id")
    evidence = materialise(ask.evidence(chunked, found.hits))
    spots = materialise(found.blind_spots.where("query_relevant")).select("*", keyed)
    quoted = evidence.withColumnRenamed("quote", "text")
    provisions = search.numeric_provisions(quoted, ["query_id", "page_number"]).select("*", keyed)
    claims = assembly.claim_statements(evidence, document_title)
    on_document = assembly.union_all(
        [
            claims,
            assembly.blind_statements(found.blind_spots),
            assembly.no_evidence_statements(questions, evidence),
            assembly.table_risk_statements(evidence),
            assembly.unreliable_number_statements(provisions),
        ]
    )
    met = conflicts.all_conflicts(claims, provisions, nearest, evidence.select("*", keyed), spots, water_rule)
    stated = assembly.union_all([site_statements, on_document, conflicts.conflict_statements(claims, met, water_rule)])
    valid, quarantined = split_valid(stated)
    risky = evidence.groupBy(keyed).agg(F.bool_or(F.coalesce(F.col("table_risk").isin(V.RISKY_LEVELS), F.lit(False))).alias("r"))
    blind = spots.select("finding_id").distinct().withColumn("b", F.lit(True))
    flags = (
        questions.select(keyed)
        .join(risky, "finding_id", "left")
        .join(blind, "finding_id", "left")
        .select(
            "finding_id",
            F.coalesce("b", F.lit(False)).alias("has_blind_spots"),
            F.coalesce("r", F.lit(False)).alias("has_risky_tables"),
        )
    )
    reviewed = materialise(critic.review(valid, flags))
    interventions = critic.findings(reviewed)
    final = apply_demotions(reviewed)
    return Findings(
        final, quarantined, met, spots, interventions,
        reports.finding_coverage(final, met, spots, interventions), evidence,
    )
