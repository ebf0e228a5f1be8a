"""The registered queries, one module per analysis stage."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
