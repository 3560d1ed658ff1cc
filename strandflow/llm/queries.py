"""The queries of this package and their SQL, gathered for the entry point."""

from __future__ import annotations

from strandflow.llm import (
    chat_format, embedding_dedup, fill_middle, language_id, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, vector_codes, warc,
)

_MODULES = (
    packing, quality_classifier, ngram_join, mixing, warc, quality_rules, chat_format, embedding_dedup, language_id, substring_dedup, license_scan, fill_middle, vector_codes,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
