"""Registered queries of this folder, with their SQL where SQL can say the same."""

from lacuna.llm import (collocations, decontamination, licenses, periodic_runs, pieces, quality_rules, secrets, sharding, similarity, site_quality,
                        token_counts, toxicity, word_bpe)

MODULES = [quality_rules, sharding, secrets, similarity, site_quality, licenses, decontamination, toxicity, token_counts, pieces, collocations, periodic_runs, word_bpe]


def all_queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
