"""One analysis from raw pages to a reviewed finding."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as X
from lacuna.operators import assembly as A
from lacuna.operators import critic, reports
from lacuna.operators import statements as S
from lacuna.plans.analyse import analyse
from lacuna.plans.ask import ingest
from lacuna.workload.reports import WATER_RULE

PROVIDER = ("provider string, endpoint string, retrieved_at timestamp, licence string, limitation string")


@pytest.fixture(scope="module")
def finding(spark):
    filler = " ".join(["general provisions of the plan area"] * 12)
    pages = [(1, filler), (2, filler + " Annexure one notification zoanthropy instrument")]
    pages += [(p, "scan") for p in range(3, 10)]
    bad = "".join({"b": chr(0x10F), "m": chr(0x175), "5": chr(0x3F1)}.get(c, c) for c in
                  "i. The lake buffer is 75 m of no development zone from the edge of water bodies in every district. ")
    pages += [(10, bad * 2)] + [(p, filler + f" chapter {p}") for p in range(11, 40)]
    raw = spark.createDataFrame([("d", p, t) for p, t in pages], "document_id string, page_number int, raw_text string")
    questions = spark.createDataFrame(
        [("q1", "d", "What lake buffer applies near zoanthropy?"), ("q2", "d", "xylophone tax")],
        "query_id string, document_id string, question string")
    who = spark.createDataFrame([(q, "overpass", "(recorded)", None, "ODbL", "Crowd-sourced.") for q in ("q1", "q2")],
                                "finding_id string, " + PROVIDER)
    nearest = spark.createDataFrame([("q1", "water", "Big Lake", 120.5), ("q2", "water", "Big Lake", 120.5)],
                                    "finding_id string, category string, label string, distance_m double")
    site = A.nearest_statements(who, nearest)
    return analyse(ingest(raw), questions, site, nearest, "Plan", WATER_RULE)


def test_conflicts_of_both_sides(finding):
    rows = {(r.finding_id, r.kind): r for r in finding.conflicts.collect()}
    water = rows[("q1", "context_vs_regulation")]
    assert "Big Lake) at 120 m" in water.measured_side and "buffers of 75 m" in water.regulatory_side
    assert len(water.related_statement_ids) >= 1 and water.severity == 1
    assert rows[("q1", "evidence_vs_absence")].title.startswith("7 page(s)")
    assert ("q1", "source_vs_source") in rows
    assert not any(f == "q2" for f, _ in rows)


def test_statements_carry_their_caveats(finding):
    rows = finding.statements.collect()
    assert finding.quarantined.count() == 0
    claims = [r for r in rows if r.agent == "regulation" and r.type == "fact"]
    assert claims and all(r.caveat for r in claims if r.text_was_repaired)
    assert all(r.limitation for r in rows if r.agent == "site" and r.type == "fact")
    missing = [r for r in rows if r.finding_id == "q1" and r.type == "assumption" and r.agent == "site"]
    assert len(missing) == 6
    assert any(r.text == A.WORDING["silent"] for r in rows if r.finding_id == "q2")


def test_confidence_is_capped_where_pages_are_unread(finding):
    standing = [r for r in finding.statements.collect() if r.agent == "conflict" and r.type == "inference"]
    assert [r.confidence for r in standing] == ["low"]
    assert standing[0].critic_notes[0].action == "reduce_confidence"
    assert {r.action for r in finding.critic_findings.collect()} >= {"reduce_confidence"}


def test_coverage_counts(finding):
    cover = {r.finding_id: r for r in finding.coverage.collect()}
    assert cover["q1"].unreadable_pages == 7 and not cover["q1"].evidence_complete
    assert cover["q2"].conflicts == 0 and cover["q2"].evidence_complete
    queue = [r for r in reports.verify_next(finding.statements).collect() if r.finding_id == "q1"]
    by_place = sorted(queue, key=lambda r: r.queue_position)
    assert [r.priority for r in by_place] == sorted(r.priority for r in queue) and by_place[0].queue_position == 1


def one(spark, **fields):
    df = spark.createDataFrame([("f", 1)], "finding_id string, ordinal long")
    kind = fields.pop("type")
    return S.statement(df, kind, "site", **{k: v if not isinstance(v, (int, list)) else F.lit(v) for k, v in fields.items()})


@pytest.mark.parametrize("fields,rule", [
    (dict(type="fact", text="x", source_kind="absent"), "fact is sourced"),
    (dict(type="inference", text="x", transformation="t", confidence_reason="b"), "inference has parents"),
    (dict(type="assumption", text="x"), "assumption can be falsified"),
    (dict(type="recommendation", text="x", responds_to="y", priority=6), "priority is 1 to 5"),
    (dict(type="fact", text="x", source_kind="document", quote="q", page_number=1, char_start=5, char_end=5), "span end exceeds start"),
])
def test_invariants(spark, fields, rule):
    valid, bad = S.split_valid(one(spark, **fields))
    assert valid.count() == 0 and rule in bad.first().broken_rules


def test_demotion_keeps_identity_and_stops_at_assumption(spark):
    df = one(spark, type="fact", text="The site has good accessibility", source_kind="dataset", provider="osm",
             retrieved_at=F.lit("2026-01-02").cast("timestamp"))
    flags = spark.createDataFrame([("f", False, False)], "finding_id string, has_blind_spots boolean, has_risky_tables boolean")
    once = S.apply_demotions(critic.review(df, flags)).first()
    assert once.id == df.first().id and once.type == "inference" and once.confidence == "low"
    assert once.transformation.startswith("Originally asserted as a fact sourced to osm (2026-01-02)")
    assert [n.action for n in once.critic_notes] == ["demote", "demote"] and once.derived_from == [once.id]
    marked = one(spark, type="assumption", text="x", falsified_by="y").withColumn(
        "critic_notes", F.array(S.note("demote", F.lit("r"), "c")))
    assert S.apply_demotions(marked).first().type == "assumption"


def test_confidence_only_falls(spark):
    df = one(spark, type="inference", text="x", transformation="t", confidence="low", confidence_reason="b",
             derived_from=F.array(F.lit("a")))
    assert S.reduce_confidence(df, F.lit(True), "medium", F.lit("r"), "c").first().confidence == "low"


def test_repair_samples(spark):
    to_bad = {"b": 0x10F, "y": 0x1C7, "m": 0x175, "n": 0x176, "r": 0x18C, "S": 0x201C, "R": 0x2018, "(": 0x37E, ")": 0x37F, '"': 0x35E}
    digits = {str(d): 0x3EC + d for d in range(10)}
    for plain in ["75 m buffer", "0123456789", "SDZ (near) \"FAR\"", "", "clean ascii; text"]:
        raw = "".join(chr({**to_bad, **digits}.get(c, ord(c))) for c in plain)
        df = spark.createDataFrame([(raw,)], "raw string").select(
            X.repaired(F.col("raw")).alias("t"), X.is_clean(F.col("raw")).alias("ok"), X.corruption_rate(F.col("raw")).alias("rate"))
        row = df.first()
        assert row.t == plain and row.ok
        assert (row.rate == 0) == (raw == plain)
    kept = spark.createDataFrame([("it’s fine", "bad ԁ")], "a string, b string").select(
        X.repaired(F.col("a")).alias("a"), X.suspect_count(F.col("a")).alias("n"), X.is_clean(F.col("b")).alias("clean")).first()
    assert kept.a == "it’s fine" and kept.n == 0 and not kept.clean
