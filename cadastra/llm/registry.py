"""The queries and SQL of the ten operators and of the pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "curriculum", "decontaminate", "token_store", "langid", "license_scan", "substring_dedup", "quotes", "near_dedup", "lm_score")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"cadastra.llm.{module}"), name)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
