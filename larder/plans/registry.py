"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from larder.plans.oracle_views import VIEWS


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


QUERIES: dict[str, Query] = {}


def sql_over(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the fixture views it reads, as CTEs.

    ``body`` may itself begin with ``WITH``; its CTEs then follow the views.
    """
    parts = [f"{name} AS ({VIEWS[name]})" for name in views]
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        recursive, text = True, text[len("WITH RECURSIVE "):]
        joined = ", ".join(parts + [text])
    elif text.upper().startswith("WITH "):
        joined = ", ".join(parts + [text[len("WITH "):]])
    elif parts:
        joined = ", ".join(parts) + " " + text
    else:
        return text
    return ("WITH RECURSIVE " if recursive else "WITH ") + joined


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its checking SQL."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(fn, sql_over(sql, *views) if sql else None)
        return fn

    return register
