"""Names of queries, filled by the modules of ``tessella.plans``."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.session import table

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("relational", "aggregates", "windows", "timeseries", "scalars", "fn_text", "fn_math", "fn_dates", "fn_arrays", "fn_json", "fn_types", "fn_search", "vectors", "graphs", "sketches", "stores", "temporal", "udfs", "extras", "more", "structures")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL if there is any."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a statement names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)


def statement(name: str, text: str, oracle: str | None = None) -> None:
    """Register a Spark SQL statement; ``oracle`` where the ANSI text differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    query(name, oracle or text)(run)


def cases(name: str, source: str, oracle: str):
    """Register expressions over the rows of a statement: the function gives name to Column, and is called
    when the query runs, as Columns need a session."""

    def put(f: Callable[[], dict]) -> Callable[[], dict]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, source)
            return spark.sql(source).select(*[c.alias(k) for k, c in f().items()])

        query(name, oracle)(run)
        return f

    return put


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return str(v)


def expect(columns: str, *rows: tuple) -> str:
    """SQL of the rows themselves, for results that the dialect's manual states."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessella.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
