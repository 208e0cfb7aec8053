"""Names of the registered queries and their SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name; sql is DuckDB's equal, over the tables of `TABLES`."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = _with_sound_unions(f)
        if sql:
            ORACLES[key] = with_tables(sql)
        return f

    return add


def _with_sound_unions(f: Callable) -> Callable:
    """f in a session that deals a union's rows again before they are grouped or joined.

    Spark 4.1 keeps the partitioning of a union whose parts are dealt alike, also after adaptive execution has merged their
    partitions differently; equal keys then stay in different tasks, and counts and differences come out wrong.
    """

    @functools.wraps(f)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        return f(spark, sf_dir)

    return run


def with_tables(sql: str) -> str:
    """sql with the common tables that it names, in order, as a WITH clause."""
    from .sql_tables import TABLES

    needed: set[str] = set()

    def visit(text: str) -> None:
        for t in TABLES:
            if t not in needed and re.search(rf"\b{t}\b", text):
                needed.add(t)
                visit(TABLES[t])

    visit(sql)
    own = [f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed]
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE", body, re.IGNORECASE) else ""
    if m := re.match(r"WITH\s+(?:RECURSIVE\s+)?", body, re.IGNORECASE):
        return f"WITH {recursive}{', '.join([*own, body[m.end() :]])}" if own else body
    return f"WITH {', '.join(own)} {body}" if own else body


def _load() -> None:
    from . import audits, cohorts, evaluation, graphs, learning, panels, sampling, scans  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
