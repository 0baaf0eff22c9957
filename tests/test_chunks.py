"""What must hold for the passages of any page, and a page cut by hand."""

import random
import re

import pytest

from lacuna import values as V
from lacuna.operators.chunks import chunk_pages, with_pieces
from lacuna.operators.pages import grade_pages

HEADER = r"Plan of the Town\s*-\s*Draft 7\s*"
WORDS = ["Plot", "shall", "keep", "a", "margin", "of", "4.5", "m", "Road", "width;", "height.", "zone:", "(see", "map)"]


def page(rng):
    out = []
    for i in range(rng.randint(1, 14)):
        body = " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 12, 40, 150, 420])))
        lead = rng.choice(
            ["", "", "  ", "\n", "i. ", "iv.  ", "(b) ", "12. ", "123. ", f"{i}.{i + 1} Heading of part {i}\n",
             "6.5.3 ", f"Table {i}: Limits\n", "see Table 7 : here\n", "\n\n (c) ", "6.5\nOver the line\n",
             "Plan of the Town - Draft 7 "]
        )
        out.append(lead + body)
    return "\n".join(out)


def bare(text):
    return "".join(text.split())


@pytest.fixture(scope="module")
def cut_pages(spark):
    rng = random.Random(7)
    texts = [page(rng) for _ in range(120)]
    pages = spark.createDataFrame(
        [("d", i, t) for i, t in enumerate(texts)], "document_id string, page_number int, raw_text string"
    )
    got = {}
    for r in chunk_pages(grade_pages(pages), HEADER).where("page_quality != 'unreadable'").collect():
        got.setdefault(r.page_number, []).append(r)
    return texts, {i: sorted(rows, key=lambda r: r.char_start) for i, rows in got.items()}


def test_passages_keep_order_sizes_and_words(cut_pages):
    texts, got = cut_pages
    assert sum(map(len, got.values())) > 300
    for i, rows in got.items():
        left = bare(re.sub(HEADER, "", texts[i], flags=re.I))
        for r in rows:
            at = left.find(bare(r.text)[:40])
            assert at >= 0, (i, r.char_start)
            left = left[at:]
            assert V.MIN_CHUNK_CHARS <= len(r.text) <= V.MAX_CHUNK_CHARS + V.MIN_CHUNK_CHARS
            assert "Plan of the Town" not in r.text and r.text == r.text.strip()


def test_nothing_long_is_lost(cut_pages):
    """Only stretches under the least size are dropped, a handful of words each."""
    texts, got = cut_pages
    for i, rows in got.items():
        header = len(re.findall(HEADER, texts[i])) * 60
        boundaries = 2 + len(re.findall(r"(?m)^\s*(?:[ivx]+\.|\(\w\)|\d|.*Table)", texts[i])) * 2
        assert len(bare(texts[i])) - sum(len(bare(r.text)) for r in rows) <= header + boundaries * V.MIN_CHUNK_CHARS


def test_a_clause_marker_opens_its_passage(cut_pages):
    texts, got = cut_pages
    marked = [(i, r) for i, rows in got.items() for r in rows if r.clause_marker]
    assert len(marked) > 50
    for i, r in marked:
        # The first passage of a clause begins with its marker; later ones carry it on.
        assert re.search(rf"(?m)^\s*\(?{re.escape(r.clause_marker)}[.)]", texts[i])
    for i, r in ((i, r) for i, rows in got.items() for r in rows if r.section_number):
        assert re.search(rf"(?m)^\s*{re.escape(r.section_number)}\s", texts[i][: r.char_start + len(r.text)])


def test_a_page_cut_by_hand(spark):
    rule = "Plots keep a margin of 4.5 m to the road on every side of the building."
    text = f"2.1 Margins of plots\n{rule}\ni. {rule}\n(b) {rule}\nshort\nTable 3: Limits\n{rule}"
    pages = spark.createDataFrame([("d", 1, text)], "document_id string, page_number int, raw_text string")
    rows = sorted(chunk_pages(grade_pages(pages)).collect(), key=lambda r: r.char_start)
    assert [(r.text, r.section_number, r.clause_marker) for r in rows] == [
        (f"2.1 Margins of plots\n{rule}", "2.1", None),
        (f"i. {rule}", "2.1", "i"),
        (f"(b) {rule}\nshort", "2.1", "b"),
        (rule, "2.1", None),
    ]
    assert [r.char_start for r in rows] == [text.index(x) for x in ("2.1", "i. ", "(b)")] + [text.index("Limits") + 6]


def test_packing(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "Upper ", "end. ", "x" * 90 + " ", "y" * 1500, "\n", "a: "])
                     for _ in range(rng.randint(1, 200))).strip() for _ in range(150)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "i int, cleaned string, at int")
    for r in with_pieces(df).collect():
        parts = [p.text for p in r.pieces]
        assert bare("".join(parts)) == bare(texts[r.i])
        assert all(len(p) <= V.MAX_CHUNK_CHARS + V.MIN_CHUNK_CHARS for p in parts)
        assert all(len(p) >= V.MIN_CHUNK_CHARS for p in parts[1:])
        assert [p.at for p in r.pieces] == sorted(p.at for p in r.pieces)


def test_packing_by_hand(spark):
    one, two = "A" + "b" * 797 + "c.", "D" + "e" * 797 + "f."
    solid = "g" * 1400 + "h" * 100
    cases = {
        "One. Two. Three.": [(0, "One. Two. Three.")],
        f"{one} {two}": [(0, one), (801, two)],
        f"{one} Short one.": [(0, f"{one} Short one.")],
        solid: [(0, "g" * 1400), (1400, "h" * 100)],
        f"{one} {two} Tail.": [(0, one), (801, f"{two} Tail.")],
    }
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(cases)], "i int, cleaned string, at int")
    want = list(cases.values())
    for r in with_pieces(df).collect():
        assert [(p.at, p.text) for p in r.pieces] == want[r.i], r.i


def test_placeholder_for_unreadable_page(spark):
    pages = spark.createDataFrame([("d", 3, "stamp")], "document_id string, page_number int, raw_text string")
    row = chunk_pages(grade_pages(pages)).first()
    assert row.chunk_id == "d:p3:unreadable" and row.char_end == 5
    assert len(row.caveats) == 1 and row.section_number is None


def test_table_warning_travels_with_the_caption(spark):
    body = "\n".join(["Table 4: Sample limits with blank cells", "Item Base Total Maximum allowable",
                      "1 A 1.10  1.10 5.5", "2 B 1.20 0.30 1.50 8.5", "3 C 1.30 0.40 1.70 9.5",
                      "4 D 1.40 0.50 1.90 10.5"])
    pages = spark.createDataFrame([("d", 1, body + "\n" + "tail " * 20)],
                                  "document_id string, page_number int, raw_text string")
    rows = chunk_pages(grade_pages(pages)).collect()
    assert rows and all(r.table_risk == "severe" for r in rows)
    assert all("lost its columns" in r.caveats[-1] for r in rows)


def test_addresses_in_running_text_are_no_headings(spark, tmp_path):
    """chunk_labels gave a page with such a line a section of its own."""
    from lacuna.workload import passages

    text = "56.187.231.175 Anna Example wrote this line of running text.\n" + "More of it follows here. " * 6
    rows = [(1, text, "src1", len(text)), (2, "Table 1: Values\n1 a 2.5\n" + text, "src1", 4 * len(text)), (3, "short", "src1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.page_number, r.label, r.n) for r in passages.chunk_labels(spark, str(tmp_path)).collect()}
    assert got == {(1, "p. 1", 1), (2, "p. 2", 1), (3, "p. 3", 1)}
    structured = chunk_pages(grade_pages(spark.createDataFrame([("d", 1, text)], "document_id string, page_number int, raw_text string")))
    assert structured.first().section_number == "56.187.231.175"
