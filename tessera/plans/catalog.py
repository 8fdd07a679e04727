"""All queries of the core and their SQL."""

from __future__ import annotations

from tessera.plans import files, given, graphs, learning, problems, relational, streams, texts, trips

_PARTS = (problems, texts, relational, trips, graphs, learning, streams, files, given)

QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
