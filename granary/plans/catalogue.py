"""All queries by name, and the SQL that another engine answers them with."""

from __future__ import annotations

from granary.plans import aggregates, changes, joins, numbers, ordering, predicates, programs, relational, scalars, streams, windows

MODULES = (relational, predicates, joins, aggregates, windows, ordering, scalars, numbers, changes, programs, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
