"""Queries of the library and, beside each, its DuckDB SQL where plain SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _counts(sql: str) -> str:
    """DuckDB's count_if is a HUGEINT, null where all its values are; Spark's is a bigint."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:k]}coalesce(CAST({sql[k:end]} AS BIGINT), 0)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _counts(sql)
        return f

    return register
