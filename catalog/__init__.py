"""Queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import re

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to the views of ``catalog.ctes``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it refers to, directly or through others."""
    from catalog.ctes import VIEWS

    names = list(VIEWS)

    def mentioned(text: str) -> set[str]:
        return {n for n in names if re.search(rf"\b{n}\b", text)}

    own = re.findall(r"(?:\bWITH|,)\s*(\w+)\s+AS\s*\(", sql)
    todo, needed = mentioned(sql) - set(own), set()
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= mentioned(VIEWS[name]) - needed - {name}
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names if n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def load() -> None:
    """Import every module that registers queries."""
    from catalog import (  # noqa: F401
        q_documents,
        q_evaluation,
        q_market,
        q_models,
        q_news,
        q_resample,
        q_sector,
        q_sources,
        q_streams,
        q_trades,
    )
