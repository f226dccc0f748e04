"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(read)``; ``read(table_name)`` gives a table of the data directory."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: table(spark, sf_dir, t))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def lit(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def worded(pattern: str) -> str:
    """A pattern whose word boundaries are by Unicode, for an engine whose own are not: they consume the neighbour."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            opens = i + 2 < len(pattern) and (pattern[i + 2].isalpha() or pattern[i + 2] in "[(")
            out += r"(?:^|[^\p{L}\p{N}_])" if opens else r"(?:[^\p{L}\p{N}_]|$)"
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out


def any_match(column: str, patterns) -> str:
    """SQL: whether any pattern is found."""
    return f"regexp_matches({column}, {lit('|'.join(f'(?:{worded(p)})' for p in patterns))})"
