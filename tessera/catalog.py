"""The registered queries of the tensor operators, and the SQL that each must agree with."""

from __future__ import annotations

from tessera.queries import elementwise, factors, fields, networks, products, reductions, solvers, streams

_PARTS = (reductions, elementwise, products, networks, fields, factors, solvers, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
#: Queries without SQL.
ALONE = {name: query for part in _PARTS for name, query in getattr(part, "ALONE", {}).items()}
