"""Checked queries, one module per family of the operator inventory."""

from __future__ import annotations

from importlib import import_module

from kinfold.queries.base import REGISTRY

FAMILIES = ("parsing", "profiling", "sampling", "scoring", "documents", "sources", "modelling")

__all__ = ["REGISTRY", "load_all"]


def load_all() -> None:
    for f in FAMILIES:
        import_module(f"kinfold.queries.{f}")
