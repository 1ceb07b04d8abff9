"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corvellum.llm import chat_format, chat_repair, decontaminate, license_scan, line_templates, order_minhash, packed_ids, pieces, quality, stages, suffix_dedup, unit_dedup, url_filter

_MODULES = (url_filter, unit_dedup, decontaminate, pieces, line_templates, license_scan, order_minhash, quality, chat_format, suffix_dedup, packed_ids, chat_repair)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": stages.run}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()} | ({} if stages.ORACLE_SQL is None else {"pipeline": stages.ORACLE_SQL})
