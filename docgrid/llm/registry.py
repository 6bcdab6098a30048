"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import chat, decontam, fingerprint, langid, line_dedup, mixing, ngram_join, pii, substring_dedup, warc

MODULES = (warc, mixing, langid, ngram_join, substring_dedup, decontam, line_dedup, pii, chat, fingerprint)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
