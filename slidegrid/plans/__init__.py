"""Registered queries; importing the modules fills the registry."""

import importlib
import pkgutil

from slidegrid.plans.registry import ORACLE_SQL, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module.endswith("_queries"):
        importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLE_SQL", "QUERIES"]
