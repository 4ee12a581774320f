"""All queries of the library with their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and ORACLE_SQL.
MODULES = ("operators.fold", "operators.admission", "operators.codecs", "operators.layout", "operators.replog", "operators.consensus", "operators.invariants", "operators.observe", "operators.sim", "sources.segments", "streaming.admission")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"chronofold.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
