"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("attribute_queries", "spatial_queries", "kernel_queries", "source_queries", "building_queries")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"cadastra.plans.{module}"), name)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
