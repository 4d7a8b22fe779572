"""Queries over the tables of a folder, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("training", "statistics", "profiles", "shapes", "reports", "sources")


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"curvelake.plans.{name}").QUERIES
    return out


def all_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"curvelake.plans.{name}").SQL
    return out
