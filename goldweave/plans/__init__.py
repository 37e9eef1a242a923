"""Bindings of the operators to the driver's tables."""

import importlib

MODULES = ("scalars", "identity", "resolution", "evidence", "sequences", "reports", "storage", "providers", "assembly", "incremental", "phrases", "people", "checks")


def load() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"goldweave.plans.{name}")
