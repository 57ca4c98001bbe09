"""Queries of the graph operators, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("flow", "structure", "upkeep", "knowledge")


def _all():
    return {k: v for t in TOPICS for k, v in import_module(f"symbolweave.plans.{t}").QUERIES.items()}


def queries():
    return {name: call for name, (call, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}
