"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from ledgerline.plans import command_queries, graph_queries, lookup_queries, replay_queries, rollup_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (rollup_queries, text_queries, graph_queries, command_queries, replay_queries, lookup_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
