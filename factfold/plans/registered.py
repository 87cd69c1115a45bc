"""Registration of queries over a directory of tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")

#: Tokens as SQL's own pattern, for texts whose raw strings have the delimiters x0, x1, x2 or none: it has no references back.
_SUFFIX = r"(?:[\p{L}_][\p{L}\p{N}_]*)?"
TOKEN_SQL = "|".join([
    r"(?:[ \t\n\x0B\f\r]|\\\r?\n)+",
    r"//(?:[^\\\n]|\\(?:\r\n|(?s:.)))*\\?",
    r"/\*(?s:.*?)(?:\*/|\z)",
    *(rf'(?:u8|[uUL])?R"{d}\((?s:.*?)(?:\){d}"|\z){_SUFFIX}' for d in ("", "x0", "x1", "x2")),
    rf'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|(?s:.)))*"{_SUFFIX}',
    rf"(?:u8|[uUL])?''(?:[^''\\\n]|\\(?:\r\n|(?s:.)))+''{_SUFFIX}",
    r"\.?[0-9](?:[eEpP][+-]|''[0-9A-Za-z_]|[0-9A-Za-z_.])*",
    r"[\p{L}_][\p{L}\p{N}_]*",
    r"<=>|<<=|>>=|->\*|\.\.\.|::|->|\.\*|\+\+|--|<<|>>|&&|\|\||##|[-+*/%&|^<>=!]=|(?s:.)",
])
