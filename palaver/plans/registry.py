"""Registry pairing each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread_small_scan

TEXT_TABLES = {"documents", "pages", "conversations"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_small_scan(df) if name in TEXT_TABLES else df


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pattern(pattern: str) -> str:
    """A pattern of the library as a SQL literal in RE2 spelling."""
    p = pattern.replace("(?dm)", "(?m)").replace(r"\p{IsLatin}\p{Punct}", r"\p{Latin}[:punct:]")
    return quoted(p)


def sql_steps(expr: str, steps: list[tuple[str, str]]) -> str:
    """The SQL form of a chain of replacements."""
    for pattern, repl in steps:
        repl = repl.replace("$1", r"\1").replace("$2", r"\2")
        lines = repl.split("\n")
        literal = " || chr(10) || ".join(quoted(x) for x in lines)
        expr = f"regexp_replace({expr}, {sql_pattern(pattern)}, {literal}, 'g')"
    return expr


def sql_all(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {sql_pattern(pattern)}, {group})"


def sql_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)
