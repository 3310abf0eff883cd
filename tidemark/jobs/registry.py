"""All registered queries of the library proper, gathered from the job modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("vector_jobs", "document_jobs", "event_jobs", "search_jobs")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"tidemark.jobs.{name}"), attribute).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
