"""Queries and the DuckDB SQL that gives the same rows, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Pieces of SQL, written out by hand; none is taken from the operators.
WS = r"[ \t\n\r\f\x0B]+"
BEFORE, AFTER = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def hint(text: str, words: str) -> str:
    return f"regexp_matches({text}, '(?i){BEFORE}({words}){AFTER}')".replace("we('?re", "we(''?re")


def sentences(text: str, least: int, most: int) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]){WS}', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: length(s) BETWEEN {least} AND {most})"


def unique(items: str) -> str:
    return f"list_filter({items}, lambda s, i: list_position(list_transform({items}, lambda t: lower(trim(t))), lower(trim(s))) = i)"
