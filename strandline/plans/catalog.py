"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from strandline.plans import check_queries, claim_queries, event_queries, graph_queries, registry_queries, research_queries, snapshot_queries, text_queries

FLAGSHIP = "distinct_usable_pages"

_MODULES = (snapshot_queries, text_queries, graph_queries, research_queries, claim_queries, check_queries, registry_queries, event_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: f for m in _MODULES for name, f in m.SQL.items()}
