"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["token_counts", "decontaminate", "importance", "url_filter", "line_dedup", "ngram_jaccard", "spotsigs", "chat_format", "language_id", "bpe", "collocations", "filter_audit", "suffix_dedup"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
