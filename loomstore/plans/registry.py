"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from loomstore.plans import analysis, integrity, memory

QUERIES: dict = {}
SQL: dict = {}
for _module in (integrity, memory, analysis):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)

FLAGSHIP = "dedup_decisions"
