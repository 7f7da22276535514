"""All named queries of the core."""

from __future__ import annotations

from memlode.plans import activity, insight, references, relational, search, writing

FLAGSHIP = "search_balanced"
_PARTS = (relational.C, activity.C, search.C, insight.C, writing.C)
QUERIES = {**references.QUERIES, **{name: query for part in _PARTS for name, query in part.queries.items()}}
SQL = {**references.SQL, **{name: sql for part in _PARTS for name, sql in part.sql.items()}}
