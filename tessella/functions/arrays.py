"""Arrays. Positions count from 1; a subscript outside gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import numbers
from tessella.functions.base import col


def depth(kind: T.DataType) -> int:
    """array_ndims, by the column's type."""
    n = 0
    while isinstance(kind, T.ArrayType):
        n, kind = n + 1, kind.elementType
    return n


def array_ndims(a: Column, kind: T.DataType) -> Column:
    return F.when(F.size(a) > 0, F.lit(depth(kind)))


def array_length(a: Column, dimension: int = 1) -> Column:
    for _ in range(dimension - 1):
        a = F.get(a, F.lit(0))
    return F.when(F.size(a) > 0, F.size(a))


array_upper = array_length


def array_lower(a: Column, dimension: int = 1) -> Column:
    return F.when(array_length(a, dimension).isNotNull(), F.lit(1))


def array_dims(a: Column, kind: T.DataType) -> Column:
    """Like ``[1:2][1:3]``."""
    return F.when(F.size(a) > 0, F.concat(*[F.concat(F.lit("[1:"), array_length(a, d).cast("string"), F.lit("]")) for d in range(1, depth(kind) + 1)]))


def cardinality(a: Column, kind: T.DataType) -> Column:
    """Elements in all dimensions."""
    for _ in range(depth(kind) - 1):
        a = F.flatten(a)
    return F.when(a.isNotNull(), F.size(a))


def array_fill(value, sizes: list[int]) -> Column:
    out = col(value)
    for n in reversed(sizes):
        out = F.array_repeat(out, n)
    return out


def array_position(a: Column, x, start: int = 1) -> Column:
    """The first place from ``start`` on; nulls can be looked for; null if there is none."""
    found = array_positions(a, x)
    return F.get(F.filter(found, lambda i: i >= start), F.lit(0))


def array_positions(a: Column, x) -> Column:
    at = F.transform(a, lambda v, i: F.when(v.eqNullSafe(col(x)), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def array_replace(a: Column, old, new) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(col(old)), col(new)).otherwise(v))


def array_remove(a: Column, x) -> Column:
    """All equal elements; null removes nulls."""
    return F.filter(a, lambda v: ~v.eqNullSafe(col(x)))


def array_cat(a: Column, b: Column) -> Column:
    """A null side is nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_append(a: Column, x) -> Column:
    return F.array_append(a, col(x))


def array_prepend(x, a: Column) -> Column:
    return F.concat(F.array(col(x)), a)


def array_reverse(a: Column) -> Column:
    return F.reverse(a)


def array_sort(a: Column, descending: bool = False) -> Column:
    """Nulls come last, or first where descending."""
    s = F.array_sort(a)
    return F.reverse(s) if descending else s


def array_shuffle(a: Column, seed: int, *key: Column) -> Column:
    """An order by hash of seed, key and place, so that reruns agree."""
    return F.transform(F.array_sort(F.transform(a, lambda v, i: F.struct(numbers.random(seed, i, *key).alias("r"), i.alias("i"), v.alias("v")))), lambda s: s["v"])


def array_sample(a: Column, n: int, seed: int, *key: Column) -> Column:
    return F.slice(array_shuffle(a, seed, *key), 1, n)


def trim_array(a: Column, n: int) -> Column:
    """Without the last n elements."""
    return F.slice(a, F.lit(1), F.size(a) - n)


def array_slice(a: Column, low, high) -> Column:
    """a[low:high], cut to what is there."""
    lo = F.greatest(col(low), F.lit(1))
    hi = F.least(col(high), F.size(a))
    return F.slice(a, lo, F.greatest(hi - lo + 1, F.lit(0)))


def generate_subscripts(a: Column, dimension: int = 1, backwards: bool = False) -> Column:
    """A row for each place."""
    n = array_length(a, dimension)
    places = F.when(n > 0, F.sequence(F.lit(1), n))
    return F.explode(F.reverse(places) if backwards else places)


def contains(a: Column, b: Column) -> Column:
    """a @> b: every element of b is in a; nulls are in nothing."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def contained(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlap(a: Column, b: Column) -> Column:
    """a && b."""
    return F.exists(b, lambda x: x.isNotNull() & F.coalesce(F.array_contains(a, x), F.lit(False)))


def less(a: Column, b: Column) -> Column:
    """Element by element, then by length."""
    return a < b


# sets of integers: sorted and without repeats


def int_sort(a: Column) -> Column:
    return F.array_sort(a)


def int_uniq(a: Column) -> Column:
    """Without repeats beside each other."""
    return F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1)))


def int_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def int_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def int_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def int_index(a: Column, x) -> Column:
    return F.array_position(a, col(x)).cast("int")


def int_query(a: Column, text: str) -> Column:
    """a @@ '1&(2|!3)'."""
    import re

    tokens, at = re.findall(r"\d+|[&|!()]", text), [0]

    def take() -> str:
        at[0] += 1
        return tokens[at[0] - 1]

    def unit() -> Column:
        t = take()
        if t == "!":
            return ~unit()
        if t == "(":
            out = either()
            take()
            return out
        return F.array_contains(a, int(t))

    def both() -> Column:
        out = unit()
        while at[0] < len(tokens) and tokens[at[0]] == "&":
            take()
            out = out & unit()
        return out

    def either() -> Column:
        out = both()
        while at[0] < len(tokens) and tokens[at[0]] == "|":
            take()
            out = out | both()
        return out

    return either()
