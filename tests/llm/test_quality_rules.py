import re

from odd_rows import ROWS, clashing, folder, table
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import quality_rules as Q


def plain(text):
    """The measurements by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(lines),
            sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\tÄ😀\x1c\x85Z", max_size=60))
def test_measure_is_its_definition(text):
    assert Q.measure(text) == plain(text)


def test_odd_rows(spark, tmp_path):
    rows = Q.op1_quality_rules(spark, folder(clashing(table(spark)), tmp_path)).collect()
    short = [(i, t) for i, t, *_ in ROWS if len(t or "") < 1000]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, *(r[m] for m in Q.MEASURES)) for r in rows if r.n_words < 1000), key=key)
    assert got == sorted(((i, *plain(t)) for i, t in short), key=key) and len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)


def test_empty_table(spark, tmp_path):
    assert Q.op1_quality_rules(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_ablation_equals_leaving_rules_out(spark):
    rows = spark.createDataFrame([(i, i % 64) for i in range(500)], "doc_id long, failed long")
    got = {(r.policy, r.rule): (r.documents, r.rejected, r.fails, r.only) for r in Q.ablation(rows).collect()}
    bits = [i % 64 for i in range(500)]
    for name, _, rules in Q.POLICIES:
        m = Q.mask(rules)
        for r in rules:
            left = m & ~Q.bit(r)
            want = (500, sum(b & m != 0 for b in bits), sum(b & Q.bit(r) != 0 for b in bits), sum(b & m != 0 and b & left == 0 for b in bits))
            assert got[name, r] == want


def test_policy_versions_read_the_same_ledger(spark):
    rows = spark.createDataFrame([(1, 0), (2, Q.bit("symbols")), (3, Q.mask(["few_words", "symbols"]))], "doc_id long, failed long")
    base = {r.doc_id: (r.kept, r.only_rule) for r in Q.apply_policy(rows, Q.BASE_RULES).collect()}
    assert base == {1: (True, None), 2: (True, None), 3: (False, "few_words")}


def test_clean_documents_are_kept(spark):
    """Of documents labelled good, none fails a rule that the contract does not set."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op1_quality_rules(spark, sf).join(labels, "doc_id")
    good, odd, junk, caught = rows.selectExpr(
        "sum(quality)", "sum(if(quality = 1 AND NOT kept AND NOT base_failed, 1, 0))", "sum(1 - quality)",
        "sum(if(quality = 0 AND NOT kept, 1, 0))").first()
    assert odd <= 0.002 * good, (good, odd)
    assert caught >= 0.5 * junk, (junk, caught)
