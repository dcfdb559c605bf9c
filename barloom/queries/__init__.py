"""Registered queries with their SQL counterparts, one module per operator family."""
from importlib import import_module

_MODULES = ["source_queries", "panel_queries", "schedule_queries", "text_queries", "signal_queries", "risk_queries", "ledger_queries", "stats_queries", "monitor_queries"]
QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"barloom.queries.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
