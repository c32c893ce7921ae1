"""All registered queries."""

import importlib

from sigspark.plans.registry import ORACLES, QUERIES

FAMILIES = ("filtering", "windowing", "health", "tables", "ingest", "business", "policies", "streams")
for _family in FAMILIES:
    importlib.import_module(f"sigspark.plans.{_family}")

__all__ = ["ORACLES", "QUERIES"]
