"""Imports the modules that register queries."""

from __future__ import annotations

import importlib
import pkgutil

import corvine.plans


def load_all() -> None:
    for m in pkgutil.iter_modules(corvine.plans.__path__):
        importlib.import_module(f"corvine.plans.{m.name}")
