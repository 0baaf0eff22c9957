"""Steps that many queries share: worked out once, and right on odd input."""

from pyspark.sql import functions as F

from lacuna.functions import text as X
from lacuna.operators import blind as B
from lacuna.operators import chunks as C
from lacuna.operators import tables as T
from lacuna.operators.ranges import number_rows


def test_lines_with_every_end_and_size(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "\n", "a", "a\n", "a\n\n", "\n\na", *[f"a{e}b" for e in ends], *[f"é\n{e}" for e in ends]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.numbered_lines(F.col("t")).alias("l")).collect():
        assert [x.text for x in r.l] == r.t.splitlines()
        assert [x.size for x in r.l] == [len(x) for x in r.t.splitlines(keepends=True)]
        assert [x.line for x in r.l] == list(range(len(r.l)))


def test_each_line_and_header_is_worked_on_once(spark):
    """A text was split five times for its lines, a header set in small letters once per hint."""
    def plan(column):
        return spark.range(1).select(F.col("id").cast("string").alias("t")).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()

    assert plan(X.numbered_lines(F.col("t"))).count("split(") == 1
    low = plan(T.declared_subcolumns(F.col("t")))
    # An array of the one lowered text is made outside the filter over hints.
    assert "array(lower(" in low and low.count("lower(") == 1 and "contains(lower(" not in low


def test_captions_follow_no_word_character(spark):
    lines = ["Table 1: a", "see Table 2: b", "xTable 3: c", "_Table 4: d", "éTable 5: e", "Table 6. f", "xTable 7: g Table 8: h"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    assert [r.i for r in df.where(F.col("t").rlike(C.CAPTION_LINE)).orderBy("i").collect()] == [0, 1, 6]


def test_clause_openings(spark):
    body = " of text that is long enough to be kept as one segment of its page, and then some."
    starts = ["", "iv. x", "(b) x", "12. x", " \t(c) x", "123. x", "(bb) x"]
    pages = spark.createDataFrame([(i, s + body) for i, s in enumerate(starts)], "i int, text string")
    found = {r.i: r.segments[-1].clause_marker for r in C.with_segments(pages).select("i", "segments").collect()}
    assert found == {0: None, 1: "iv", 2: "b", 3: "12", 4: "c", 5: None, 6: None}


def test_rows_are_dealt_out_once_for_their_numbers(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20000).select("id", (F.col("id") % 3).alias("k"), F.repeat(F.lit("x"), 50).alias("text")).write.parquet(path)
    numbered = number_rows(spark.read.parquet(path), "k", "id", "n")
    assert numbered.count() == 20000
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_only_pages_beside_regions_have_their_spaces_collapsed(spark):
    chunks = spark.createDataFrame([("d", 1, 0, "clean", "a  b\n c"), ("d", 2, 0, "clean", "e \t f")], "document_id string, page_number int, chunk_ordinal int, page_quality string, text string")
    wanted = spark.createDataFrame([("d", 2, 3, 1, -1)], "document_id string, page_start int, page_end int, page_number int, side int")
    ends = B.page_ends(chunks, wanted)
    assert [r.page_text for r in ends.collect()] == ["a b c"]
    plan = ends._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[plan.index("Join Inner"):]


def test_collapse_of_every_kind_of_space(spark):
    cases = [a + b + c for a in ["", "x", " ", "\t"] for b in X.SPACE_CHARS for c in ["", " ", "y", "\xa0", " y  z"]] + ["a b c", " ", ""]
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.collapse(F.col("t")).alias("c")).collect()
    for r in got:
        plain = "".join(" " if ch in X.SPACE_CHARS else ch for ch in r.t)
        assert r.c == " ".join(w for w in plain.split(" ") if w)
    # Single spaces, most of any text, are passed over.
    assert spark.range(1).select(F.lit("a b c").rlike(X._LOOSE_SPACE).alias("r")).first().r is False


def test_spots_of_findings_read_no_text(spark, tmp_path):
    from lacuna.workload import reports

    docs = spark.createDataFrame([(i, "text", "en", "src1", 20) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spots = reports._spots(spark, str(tmp_path))
    assert sorted(r.page_start for r in spots.collect()) == [5, 10]
    scans = [part.split("]")[0] for part in spots._jdf.queryExecution().executedPlan().toString().split("FileScan parquet ")[1:]]
    assert scans and not any("text#" in columns for columns in scans)
