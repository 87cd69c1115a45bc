"""SQL over the store: lazy rows, mapped rows, eager collection, with strict numbers of bound values."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

T = TypeVar("T")


class QueryError(Exception):
    """A statement that can't be prepared, bound or run."""


def _markers(sql: str) -> int:
    """Positional markers outside strings, quoted names and comments."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    return bare.count("?")


def frame(spark: SparkSession, sql: str, *binds: Any) -> DataFrame:
    if (n := _markers(sql)) != len(binds):
        raise QueryError(f"the statement has {n} markers, {len(binds)} values are bound")
    try:
        return spark.sql(sql, args=list(binds)) if binds else spark.sql(sql)
    except PySparkException as e:
        raise QueryError(str(e)) from e


def rows(spark: SparkSession, sql: str, *binds: Any) -> Iterator[Row]:
    """A lazy single pass; at most one partition is held at a time, and stopping early runs no more of them."""
    df = frame(spark, sql, *binds)
    return (r for r in df.toLocalIterator())


def query(spark: SparkSession, sql: str, mapper: Callable[[Row], T], *binds: Any) -> Iterator[T]:
    return (mapper(r) for r in rows(spark, sql, *binds))


def collect(items: Iterator[T]) -> list[T]:
    """All items at once. Raw rows are for a single pass and are refused: map them first."""
    out = []
    try:
        for item in items:
            if isinstance(item, Row):
                raise QueryError("raw rows can't be collected; map them to values")
            out.append(item)
    except PySparkException as e:
        raise QueryError(str(e)) from e
    return out


def columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(table).schema]
