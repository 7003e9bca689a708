"""Registered queries, one module per area."""

import importlib
import os
import pkgutil


def load():
    from wavelane.plans import registry

    for module in pkgutil.iter_modules([os.path.dirname(__file__)]):
        if module.name.endswith("_queries"):
            importlib.import_module(f"wavelane.plans.{module.name}")
    return registry
