"""Query registry; importing it loads every plan module."""

import importlib
import pkgutil

from parley.plans.registry import ORACLE, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLE", "QUERIES"]
