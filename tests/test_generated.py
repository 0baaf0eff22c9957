"""Prompts, replies and residual notes."""

from pyspark.sql import functions as F

from lacuna.operators import generated as G
from lacuna.operators import pages as P


def test_reply_json_tolerates_fences_and_prose(spark):
    texts = ['{"findings": [{"problem": "p", "severity": "high"}]}',
             '```json\n{"findings": [{"problem": "p", "severity": "high"}]}\n```',
             'Sure: {"findings": [{"problem": "p", "severity": "high"}]} as asked', "nothing here", '{"findings": []}', "```"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "finding_id string, text string")
    got = {(r.finding_id, r.action) for r in G.review_findings(df).collect()}
    assert got == {(i, "flag_misleading") for i in "012"}


def test_prompt_repeats_caveats_and_gaps(spark):
    q = spark.createDataFrame([("q", "d", "What width?"), ("r", "d", "Else?")], "query_id string, document_id string, question string")
    e = spark.createDataFrame([("q", 2, "p. 4", "second", []), ("q", 1, "p. 3", "first", ["careful"])],
                              "query_id string, rank int, citation_label string, quote string, caveats array<string>")
    notes = spark.createDataFrame([("q", "2 page(s) unread")], "query_id string, coverage_note string")
    rows = G.prompts(q, e, notes).collect()
    assert len(rows) == 1
    assert "[1] (p. 3) first\n   RELIABILITY: careful\n[2] (p. 4) second" in rows[0].prompt
    assert rows[0].prompt.endswith("NOT READABLE: 2 page(s) unread")
    assert [r.ok for r in G.refusals(q).collect()] == [False, False]


def test_residual_notes_name_the_character(spark):
    raw = spark.createDataFrame([("d", 1, "x" * 130 + chr(0x501) * 2)], "document_id string, page_number int, raw_text string")
    note = P.describe_residual(P.suspect_histogram(P.grade_pages(raw))).first().note
    assert note == f"U+0501 '{chr(0x501)}' ×2 (CYRILLIC SMALL LETTER KOMI DE)"


def test_headline_of_a_clean_document(spark):
    raw = spark.createDataFrame([("d", 1, "plain words " * 20)], "document_id string, page_number int, raw_text string")
    g = P.grade_pages(raw)
    risky = spark.createDataFrame([], "document_id string, page_number int")
    runs = P.largest_run(P.unreadable_runs(g))
    line = P.headline(P.coverage_report(g), runs, risky).select(F.col("findings")[0].alias("f")).first().f
    assert line.startswith("No unreadable pages")
