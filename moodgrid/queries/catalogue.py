"""Loads the modules that register queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("columns", "text", "joins", "aggregates", "windows", "files", "models", "compositions")


def load() -> None:
    for name in MODULES:
        import_module(f"moodgrid.queries.{name}")
