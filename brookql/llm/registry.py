"""The corpus operators' queries and their SQL, by query name."""

from __future__ import annotations

from brookql.llm import audio, decontaminate, jaccard_join, language_id, mixing, quality, substring_dedup, suffix_dedup, toxicity, url_reputation

MODULES = [mixing, suffix_dedup, decontaminate, substring_dedup, jaccard_join, toxicity, url_reputation, language_id, quality, audio]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
