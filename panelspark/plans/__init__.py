"""Registered queries: the Spark plan and, where SQL can say it, the SQL that checks it."""

from importlib import import_module
from pkgutil import iter_modules


def load():
    """Import every module of this package, so that all queries are registered."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
    return import_module(f"{__name__}.registry")
