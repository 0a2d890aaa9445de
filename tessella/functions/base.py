"""What the function modules share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE, BOOL, BINARY = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.BinaryType()
STRINGS = T.ArrayType(STRING)


def col(x) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def rowwise(fn: Callable, returns: T.DataType, strict: bool = True) -> Callable[..., Column]:
    """A function of Columns from a Python function of one row's values, for what built-ins can't express: it gets
    Arrow batches. ``strict``: a null argument gives null without a call."""

    def batch(*cols: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = zip(*(c.to_pylist() for c in cols))
        return pa.array([None if strict and any(x is None for x in r) else fn(*r) for r in rows], to_arrow_type(returns))

    return lambda *cols: F.arrow_udf(batch, returns)(*[col(c) for c in cols])


def strict(value: Column, *args: Column) -> Column:
    """``value``, or null if an argument is."""
    some = F.lit(False)
    for a in args:
        some = some | col(a).isNull()
    return F.when(~some, value)


def let(f: Callable[..., Column], *values: Column) -> Column:
    """``f(*values)`` with each value computed once, however often ``f`` names it: expressions are trees, and steps that
    build on each other would else grow by powers."""
    row = F.struct(*[col(v).alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda r: f(*[r[f"v{i}"] for i in range(len(values))])), F.lit(0))
