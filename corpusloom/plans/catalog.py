"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import corpus, evaluation, samples, tables

_MODULES = (corpus, samples, evaluation, tables)


def queries() -> dict[str, Callable]:
    return {k: v for m in _MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
