"""Registered queries. Importing this package fills ``QUERIES`` and ``ORACLES``."""

import importlib
import pkgutil

from panelloom.plans.base import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
