"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, webp

MODULES = (token_counts, mixing, packing, line_dedup, quality_classifier, ngram_join, suffix_dedup, language_id, quality_rules, webp)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
