"""Registry of queries with their oracle SQL, and the shared SQL views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .bindings import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _closure(text: str, seen: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
        if name in VIEWS and name not in seen:
            _closure(VIEWS[name], seen)
            seen.append(name)


def _unsigned_zero(sql: str) -> str:
    """Rounding may leave a negative zero in one engine only; adding zero clears the sign."""
    return re.sub(r"\bround\(", "0.0::DOUBLE + round(", sql)


def expand(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in dependency order."""
    sql = sql.strip()
    seen: list[str] = []
    _closure(sql, seen)
    parts = [f"{n} AS (\n{_unsigned_zero(VIEWS[n])}\n)" for n in seen]
    sql = _unsigned_zero(sql)
    if head := re.match(r"(?i)with\s+(recursive\s+)?", sql):
        return f"WITH {head[1] or ''}" + ",\n".join([*parts, sql[head.end() :].strip()]) if parts else sql
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def query(key: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add
