"""Tensors as columns: a struct of dims (up to eight) and data in row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import let


def tensor(data: Column, dims: list[int]) -> Column:
    """An error if the numbers don't fill the dimensions."""
    if not 1 <= len(dims) <= 8:
        raise ValueError("one to eight dimensions")
    n = 1
    for d in dims:
        n *= d
    ok = F.when(F.size(data) != n, F.raise_error(F.lit("data does not fill the dimensions")).cast("array<double>")).otherwise(F.transform(data, lambda x: x.cast("double")))
    return F.struct(F.lit(dims).alias("dims"), ok.alias("data"))


def ndims(t: Column) -> Column:
    return F.size(t["dims"])


def reshape(t: Column, dims: list[int]) -> Column:
    return tensor(t["data"], dims)


def at(t: Column, *index) -> Column:
    """An element by its place, counted from 0."""
    flat = F.lit(0)
    for i, x in enumerate(index):
        flat = flat * F.get(t["dims"], F.lit(i)) + x
    return F.get(t["data"], flat)


def _each(a: Column, b: Column, f) -> Column:
    def both(a: Column, b: Column) -> Column:
        data = F.when(a["dims"] == b["dims"], F.zip_with(a["data"], b["data"], f))
        bad = F.raise_error(F.lit("different dimensions")).cast("array<double>")
        return F.struct(a["dims"].alias("dims"), F.coalesce(data, F.when(a["dims"] != b["dims"], bad)).alias("data"))

    return let(both, a, b)


def add(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x * y)


def scale(t: Column, k: float) -> Column:
    return F.struct(t["dims"].alias("dims"), F.transform(t["data"], lambda x: x * k).alias("data"))


def total(t: Column) -> Column:
    return F.aggregate(t["data"], F.lit(0.0), lambda s, x: s + x)


def transpose(t: Column) -> Column:
    """Of two dimensions."""

    def turned(t: Column) -> Column:
        r, c = F.get(t["dims"], F.lit(0)), F.get(t["dims"], F.lit(1))
        data = F.transform(F.sequence(F.lit(0), r * c - 1), lambda i: F.get(t["data"], (i % r) * c + F.floor(i / r).cast("int")))
        return F.struct(F.array(c, r).alias("dims"), data.alias("data"))

    return let(turned, t)


def matmul(a: Column, b: Column) -> Column:
    """Of two dimensions each."""

    def product(a: Column, b: Column) -> Column:
        n, m, k = F.get(a["dims"], F.lit(0)), F.get(a["dims"], F.lit(1)), F.get(b["dims"], F.lit(1))
        cell = lambda i: F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0.0), lambda s, j: s + F.get(a["data"], F.floor(i / k).cast("int") * m + j) * F.get(b["data"], j * k + i % k))
        data = F.when(m == F.get(b["dims"], F.lit(0)), F.transform(F.sequence(F.lit(0), n * k - 1), cell)).otherwise(F.raise_error(F.lit("inner dimensions differ")).cast("array<double>"))
        return F.struct(F.array(n, k).alias("dims"), data.alias("data"))

    return let(product, a, b)
