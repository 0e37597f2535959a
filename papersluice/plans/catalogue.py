"""All queries of the library but those of the llm subpackage, and the SQL that checks them."""

from __future__ import annotations

from papersluice.plans import assess, decision_queries, field_queries, join_queries, layout_queries, quarantine_queries, record_queries, rule_triage, text_queries

_PARTS = (decision_queries, text_queries, field_queries, layout_queries, join_queries, record_queries, rule_triage, quarantine_queries, assess)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
