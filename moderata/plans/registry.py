"""The registered queries and their SQL."""

from __future__ import annotations

from moderata.plans import moderation, relational, streams

MODULES = (relational, moderation, streams)
QUERIES = {name: run for module in MODULES for name, run in module.registry.queries.items()}
SQL = {name: sql for module in MODULES for name, sql in module.registry.sql.items()}
