"""The pN_ queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["split", "cutoff", "pairs", "tokens", "history", "boilerplate", "scans", "packing", "mixing", "residue"]


def _merged(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"folio_spark.llm.{m}"), what, {}).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
