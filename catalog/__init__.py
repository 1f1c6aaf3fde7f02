"""Registered queries and their check SQL over the provided tables."""

from __future__ import annotations

import importlib

MODULES = ["core", "ingest", "boards", "research", "strategies", "sweeps", "learned"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
