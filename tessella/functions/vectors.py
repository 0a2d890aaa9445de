"""Vectors as arrays of numbers: distances, arithmetic, quantization. Sums are in double precision; dimensions that
differ are an error, as ``zip_with`` pads with nulls and the sum is then null, which ``checked`` turns into one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(value: Column, a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("different vector dimensions")).cast("double")).otherwise(value)


def _sum(a: Column, b: Column, f) -> Column:
    return checked(F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x), a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    """a <-> b."""
    return F.sqrt(l2_squared(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    """a <#> b."""
    return -inner_product(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    """a <+> b."""
    return _sum(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """a <=> b; null where a vector is zero."""
    cos = inner_product(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return 1 - F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))


def dims(a: Column) -> Column:
    return F.size(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def normalize(a: Column) -> Column:
    """Of length 1; zero stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def subvector(a: Column, start: int, count: int) -> Column:
    return F.slice(a, start, count)


def binary_quantize(a: Column) -> Column:
    """A text of bits: 1 where an element is above 0."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming_distance(a: Column, b: Column) -> Column:
    each = lambda s: F.regexp_extract_all(s, F.lit("."), F.lit(0))
    return F.size(F.filter(F.zip_with(each(a), each(b), lambda x, y: x != y), lambda x: x))


def jaccard_distance(a: Column, b: Column) -> Column:
    each = lambda s: F.regexp_extract_all(s, F.lit("."), F.lit(0))
    count = lambda f: F.size(F.filter(F.zip_with(each(a), each(b), f), lambda x: x))
    any_ = count(lambda x, y: (x == "1") | (y == "1"))
    return F.when(any_ == 0, 1.0).otherwise(1 - count(lambda x, y: (x == "1") & (y == "1")) / any_)


def vector_sum(a: Column, n: int) -> Column:
    """By element over a group: n sums with partial aggregation."""
    return F.array(*[F.sum(F.get(a, F.lit(i)).cast("double")) for i in range(n)])


def vector_avg(a: Column, n: int) -> Column:
    return F.array(*[F.avg(F.get(a, F.lit(i)).cast("double")) for i in range(n)])


DISTANCES = {"l2": l2_distance, "l2_squared": l2_squared, "cosine": cosine_distance, "inner": negative_inner_product, "l1": l1_distance}
