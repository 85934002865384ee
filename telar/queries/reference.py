"""All queries of the reference's operator families."""

from __future__ import annotations

import importlib

MODULES = ["derivations", "relational", "ordered", "merging", "published", "checks", "edge", "rules"]

QUERIES, SQL = {}, {}
for _name in MODULES:
    _m = importlib.import_module(f"telar.queries.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
