"""Registered queries against their SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, compare

SF = "/root/testdata/sf0.01"
# One query per operator family, at a size where each has rows; check.py runs all of them.
NAMES = ["page_grade", "unreadable_runs", "table_risk", "segments", "region_overlap", "bm25_topk", "coverage_note",
         "numeric_provisions", "nearest_per_category", "demotions", "checks_with_findings", "conflict_rules",
         "comparison_cells", "verify_next", "case_checks", "latency_quantiles",
         "climate_reading", "terrain_reading", "absent_sources", "recording_ages", "verification_rows", "checks_of_kind"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name])
    assert ok and not note.startswith("rows 0 "), note


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert {"quote", "caveats", "score"} <= set(df.columns) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 90


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_folders(tmp_path, gone):
    """A copy without the training-data folders, with or without the pipeline, has all other queries."""
    root = Path(E.__file__).resolve().parent
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", *gone)
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), any(q.startswith('op') for q in E.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 111 and said[2] == "False"
