"""Registered queries, one module per part of the operator inventory."""

from importlib import import_module

from .registry import REGISTRY, Query

MODULES = ["prep", "reshape", "describe", "traces", "choice", "inference", "estimate"]


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
