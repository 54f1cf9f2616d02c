"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from . import collocations, decontamination, html_extraction, license_scan, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_files

MODULES = [ngram_join, quality_rules, token_files, quality_classifier, secret_scan, decontamination, packing, license_scan, suffix_dedup, substring_dedup, collocations, periodic_runs, html_extraction]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
