"""The queries for the engine's own operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["page_queries", "corpus_queries", "job_queries", "stream_queries"]


def _merged(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"folio_spark.plans.{m}"), what, {}).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
