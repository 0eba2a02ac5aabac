"""All queries of the engine and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

from ledgerloom.plans import acquire, extensions, retrieval, structure

_MODULES = (acquire, structure, retrieval, extensions)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
