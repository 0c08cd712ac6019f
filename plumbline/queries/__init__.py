"""Registry of the core queries: each reads the given tables through an operator; most have the same result in SQL."""

from __future__ import annotations

from . import builds, measures, openings, ordered, points, rules, selection, shapes, spaces, streams

FLAGSHIP = "lowest_level"
_MODULES = (points, ordered, rules, streams, openings, selection, spaces, measures, shapes, builds)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
