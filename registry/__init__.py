"""Every capability as a named query over the given tables, with its SQL twin.

A module registers its queries with ``@query(name, sql)``.  ``sql`` is plain SQL for
the same tables; it is left out where SQL cannot express the result.
"""

from __future__ import annotations

from importlib import import_module

from registry.base import ORACLES, QUERIES

for _module in ("row_checks", "table_checks", "keyed_checks", "texts", "rulesets", "failures",
                "rulebook", "history", "generated", "streams", "lossless", "schemas"):
    import_module(f"registry.{_module}")

__all__ = ["ORACLES", "QUERIES"]
