"""Queries of the catalog jobs and their SQL twins; each module adds its own."""

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in ("source_queries", "audit_queries", "content_queries", "retrieval_queries", "boundary_queries"):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
