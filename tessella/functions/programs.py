"""Functions of users: SQL functions, procedures, blocks, table functions, aggregates and window functions in Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def create_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A SQL function, which the optimizer puts in where it is called; RETURNS TABLE (...) makes a table function."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def do(spark: SparkSession, block: str) -> DataFrame:
    """A block of statements: variables, conditions, loops. Gives the last query's rows."""
    return spark.sql(f"BEGIN\n{block}\nEND")


class Procedures:
    """CALL by name; a procedure runs statements on the driver and may commit between them by writing tables."""

    def __init__(self) -> None:
        self.named: dict[str, Callable] = {}

    def create(self, name: str, body: Callable) -> None:
        self.named[name] = body

    def call(self, spark: SparkSession, name: str, *args):
        if name not in self.named:
            raise KeyError(f"procedure {name} does not exist")
        return self.named[name](spark, *args)


def python_function(f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A vectorized function in Python."""
    return F.pandas_udf(f, returns)


def python_aggregate(f: Callable[[pd.Series], object], returns: str) -> Callable[..., Column]:
    """A group's values in one call. It has no partial results, so groups must fit a task; compose built-ins where they need not."""

    def one(x: pd.Series) -> float:
        return f(x)

    return F.pandas_udf(one, returns)


def composed_aggregate(parts: dict[str, Callable[[Column], Column]], final: Callable[..., Column]) -> Callable[[Column], Column]:
    """A user's aggregate from built-in ones and a final expression: it keeps partial aggregation, and moves over windows."""
    return lambda c: final(**{k: f(c) for k, f in parts.items()})


def table_function(spark: SparkSession, name: str, rows: Callable, schema: str) -> None:
    """A function from scalars to rows, for FROM and LATERAL."""

    class Rows:
        def eval(self, *args):
            yield from rows(*args)

    spark.udtf.register(name, udtf(Rows, returnType=schema))


def rows_from(*arrays: Column) -> Column:
    """ROWS FROM (f, g) WITH ORDINALITY: arrays side by side, short ones filled with nulls, and the row's number."""
    n = F.greatest(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.inline(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*[F.get(a, i - 1).alias(f"c{k + 1}") for k, a in enumerate(arrays)], i.alias("ordinality"))))


