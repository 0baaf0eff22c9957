"""Coverage of arriving pages equals that of all pages at once."""

import json
import random

from lacuna.operators import pages as P
from lacuna.streaming.coverage import coverage_stream, read_coverage, read_unreadable_runs
from lacuna.streaming.uploads import PAGES

SPOILT = "".join({"b": chr(0x10F), "m": chr(0x175)}.get(c, c) for c in "bits of mending by the name of a lamb. " * 5)


def some_pages():
    rng = random.Random(7)
    kinds = ["scan", "", "plain text of a page that can be read from its first to its last word. " * 3, SPOILT]
    pages = [("hot", p, rng.choice(kinds)) for p in range(1, 300)] + [("hot", p, "scan") for p in range(4090, 4103)]
    return pages + [("other", p, rng.choice(kinds)) for p in range(1, 40)]


def arrive(folder, name, pages):
    (folder / name).write_text("\n".join(json.dumps({"document_id": d, "page_number": p, "raw_text": t}) for d, p, t in pages))


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_any_order_restarts_and_repeats(spark, tmp_path):
    pages = some_pages()
    random.Random(8).shuffle(pages)
    come, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    come.mkdir()

    def run():
        arriving = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 2).json(str(come))
        query = coverage_stream(arriving, out, progress)
        assert query.awaitTermination(120) and query.exception() is None

    def agrees(arrived):
        graded = P.grade_pages(spark.createDataFrame(arrived, PAGES))
        assert rows(read_coverage(spark, out)) == rows(P.coverage_report(graded))
        assert rows(read_unreadable_runs(spark, out)) == rows(P.unreadable_runs(graded))

    for i in range(3):
        arrive(come, f"a{i}.json", pages[i * 60 : i * 60 + 60])
    run()
    agrees(pages[:180])
    # After a restart: the rest, a page that came before, one without a number.
    arrive(come, "b.json", pages[180:] + [pages[0], (pages[1][0], pages[1][1], "other text that is long enough to be read. " * 5), ("hot", None, "x")])
    run()
    agrees(pages)
    run()
    agrees(pages)
