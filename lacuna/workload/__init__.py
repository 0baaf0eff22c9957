"""Registered queries: each operator run over the driver's tables.

A query is a pair of a Spark program and, where SQL can say the same, its text
for a second engine to check the result with.
"""

from lacuna.workload import (
    checks,
    documents,
    evaluation,
    findings,
    geography,
    passages,
    readings,
    reports,
    retrieval,
    statements,
    structure,
)

MODULES = [documents, structure, passages, retrieval, geography, statements, checks, reports, readings, findings, evaluation]


def all_queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
