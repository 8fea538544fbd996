"""All registered queries of the event library, with their SQL twins."""

from __future__ import annotations

from siftwell.plans import entities, relational, scalars

MODULES = (relational, scalars, entities)
QUERIES = {name: make for m in MODULES for name, make in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
