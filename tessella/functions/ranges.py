"""Ranges and multiranges as columns.

A range is a struct of lo, hi, lo_inc, hi_inc and empty; a null bound is infinite. Ranges of whole numbers and dates
(``step`` given) are kept as ``[lo, hi)``, so that equal sets of values are equal structs. A multirange is a sorted array of
ranges that don't touch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import col, let


def _make(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, empty: Column) -> Column:
    gone = lambda x, to: F.when(~empty, x) if to is None else F.when(empty, F.lit(to)).otherwise(x)
    return F.struct(gone(lo, None).alias("lo"), gone(hi, None).alias("hi"), gone(lo_inc & lo.isNotNull(), False).alias("lo_inc"), gone(hi_inc & hi.isNotNull(), False).alias("hi_inc"), empty.alias("empty"))


def range_(lo, hi, bounds: str = "[)", step=None) -> Column:
    """A range; an error if lo is above hi. ``step``: 1 for whole numbers and dates."""
    lo, hi = col(lo), col(hi)
    a, b = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    bad = F.when(lo > hi, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")).otherwise(F.lit(False))
    if step is not None:
        lo = lo + (0 if bounds[0] == "[" else step)
        hi = hi + (step if bounds[1] == "]" else 0)
        a, b = F.lit(True), F.lit(False)
    empty = F.coalesce(~bad & ((lo == hi) & ~(a & b) | (lo > hi)), F.lit(False))
    return _make(lo, hi, a, b, empty)


def empty_like(r: Column) -> Column:
    return F.struct(F.nullif(r["lo"], r["lo"]).alias("lo"), F.nullif(r["hi"], r["hi"]).alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), F.lit(True).alias("empty"))


def lower(r: Column) -> Column:
    return r["lo"]


def upper(r: Column) -> Column:
    return r["hi"]


def isempty(r: Column) -> Column:
    return r["empty"]


def lower_inc(r: Column) -> Column:
    return r["lo_inc"]


def upper_inc(r: Column) -> Column:
    return r["hi_inc"]


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lo"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["hi"].isNull()


def text(r: Column) -> Column:
    show = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    body = F.concat(F.when(r["lo_inc"], "[").otherwise("("), show(r["lo"]), F.lit(","), show(r["hi"]), F.when(r["hi_inc"], "]").otherwise(")"))
    return F.when(r["empty"], "empty").when(r["empty"].isNotNull(), body)


# bounds compare as (value, whether it lies inside): where a lower bound begins, where an upper one ends


def _lo_le(a: Column, b: Column) -> Column:
    """a begins no later than b."""
    return a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])), F.lit(False))


def _hi_ge(a: Column, b: Column) -> Column:
    """a ends no earlier than b."""
    return a["hi"].isNull() | F.coalesce((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"])), F.lit(False))


def _before(a: Column, b: Column) -> Column:
    """a ends before b begins, whether or not they touch."""
    return F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))


def _touches(a: Column, b: Column) -> Column:
    """a ends where b begins, and the point lies in just one of them."""
    return F.coalesce((a["hi"] == b["lo"]) & (a["hi_inc"] != b["lo_inc"]), F.lit(False))


def contains_elem(r: Column, x) -> Column:
    """r @> x."""
    x = col(x)
    low = r["lo"].isNull() | (x > r["lo"]) | ((x == r["lo"]) & r["lo_inc"])
    high = r["hi"].isNull() | (x < r["hi"]) | ((x == r["hi"]) & r["hi_inc"])
    return F.when(x.isNotNull(), ~r["empty"] & F.coalesce(low & high, F.lit(False)))


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return b["empty"] | (~a["empty"] & _lo_le(a, b) & _hi_ge(a, b))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & ~_before(a, b) & ~_before(b, a)


def left_of(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & _before(a, b)


def not_right(a: Column, b: Column) -> Column:
    """a &< b."""
    return ~a["empty"] & ~b["empty"] & _hi_ge(b, a)


def not_left(a: Column, b: Column) -> Column:
    """a &> b."""
    return ~a["empty"] & ~b["empty"] & _lo_le(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    return ~a["empty"] & ~b["empty"] & (_touches(a, b) | _touches(b, a))


def _hull(a: Column, b: Column) -> Column:
    first, last = _lo_le(a, b), _hi_ge(a, b)
    pick = lambda c, n: F.when(c, a[n]).otherwise(b[n])
    return F.struct(pick(first, "lo").alias("lo"), pick(last, "hi").alias("hi"), pick(first, "lo_inc").alias("lo_inc"), pick(last, "hi_inc").alias("hi_inc"), F.lit(False).alias("empty"))


def merge(a: Column, b: Column) -> Column:
    """The smallest range that holds both."""
    return let(lambda a, b: F.when(a["empty"], b).when(b["empty"], a).otherwise(_hull(a, b)), a, b)


def union(a: Column, b: Column) -> Column:
    """a + b: an error where there is a gap between them."""
    gap = F.raise_error(F.lit("result of range union would not be contiguous"))
    return let(lambda a, b: F.when(a["empty"], b).when(b["empty"], a).when(overlaps(a, b) | adjacent(a, b), _hull(a, b)).otherwise(F.struct(F.nullif(a["lo"], a["lo"]).alias("lo"), F.nullif(a["hi"], a["hi"]).alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), gap.cast("boolean").alias("empty"))), a, b)


def intersection(a: Column, b: Column) -> Column:
    """a * b."""

    def both(a: Column, b: Column) -> Column:
        later, sooner = _lo_le(a, b), _hi_ge(a, b)
        pick = lambda c, n: F.when(c, b[n]).otherwise(a[n])
        got = F.struct(pick(later, "lo").alias("lo"), pick(sooner, "hi").alias("hi"), pick(later, "lo_inc").alias("lo_inc"), pick(sooner, "hi_inc").alias("hi_inc"), F.lit(False).alias("empty"))
        return F.when(overlaps(a, b), got).when(a["empty"].isNotNull() & b["empty"].isNotNull(), empty_like(a))

    return let(both, a, b)


def _pieces(a: Column, b: Column) -> Column:
    """Array of what is left of a without b: nothing, one part or two."""
    left = F.struct(a["lo"].alias("lo"), b["lo"].alias("hi"), a["lo_inc"].alias("lo_inc"), (~b["lo_inc"] & b["lo"].isNotNull()).alias("hi_inc"), F.lit(False).alias("empty"))
    right = F.struct(b["hi"].alias("lo"), a["hi"].alias("hi"), (~b["hi_inc"] & b["hi"].isNotNull()).alias("lo_inc"), a["hi_inc"].alias("hi_inc"), F.lit(False).alias("empty"))
    parts = F.array(F.when(~_lo_le(b, a), left), F.when(~_hi_ge(b, a), right))
    return F.when(a["empty"], F.slice(F.array(a), 1, 0)).when(~overlaps(a, b), F.array(a)).otherwise(F.filter(parts, lambda p: p.isNotNull()))


def difference(a: Column, b: Column) -> Column:
    """a - b: an error where two parts are left."""

    def one(a: Column, parts: Column) -> Column:
        two = F.raise_error(F.lit("result of range difference would not be contiguous"))
        none = empty_like(a)
        return F.when(F.size(parts) == 0, none).when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(F.size(parts) > 1, F.struct(none["lo"].alias("lo"), none["hi"].alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), two.cast("boolean").alias("empty")))

    return let(lambda a, b: let(one, a, _pieces(a, b)), a, b)


# -- multiranges --------------------------------------------------------------------------------


def _sorted(parts: Column) -> Column:
    """Ranges by where they begin; an infinite lower bound sorts first, as null does."""
    key = lambda r: F.struct(r["lo"].alias("a"), (~r["lo_inc"]).alias("b"), r.alias("r"))
    return F.transform(F.sort_array(F.transform(F.filter(parts, lambda r: ~r["empty"]), key)), lambda k: k["r"])


def multirange(parts: Column) -> Column:
    """An array of ranges without empty ones, in order, those that overlap or touch as one."""

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = F.coalesce(~_before(last, r) | _touches(last, r), F.lit(False))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_hull(last, r)))
        return F.when(F.size(acc) == 0, F.array(r)).when(joins, grown).otherwise(F.concat(acc, F.array(r)))

    return let(lambda s: F.aggregate(s, F.slice(s, 1, 0), lambda acc, r: add(acc, r)), _sorted(parts))


def multirange_text(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(m, text), ","), F.lit("}"))


def m_union(a: Column, b: Column) -> Column:
    return multirange(F.concat(a, b))


def m_intersection(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: intersection(x, y))))
    return multirange(pairs)


def m_difference(a: Column, b: Column) -> Column:
    return multirange(F.aggregate(b, a, lambda acc, y: F.flatten(F.transform(acc, lambda x: _pieces(x, y)))))


def m_contains_elem(m: Column, x) -> Column:
    return F.exists(m, lambda r: contains_elem(r, x))


def m_contains(a: Column, b: Column) -> Column:
    """Of a multirange: every part of b lies in one part of a."""
    return F.forall(b, lambda y: F.exists(a, lambda x: contains(x, y)))


def m_overlaps(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: overlaps(x, y)))


def m_merge(m: Column) -> Column:
    """range_merge: from the first lower bound to the last upper one."""
    return let(lambda m: F.when(F.size(m) > 0, _hull(F.get(m, F.lit(0)), F.get(m, F.size(m) - 1))), m)


def range_agg(r: Column) -> Column:
    """The union of a group's ranges, as a multirange."""
    return multirange(F.collect_list(r))


def range_intersect_agg(r: Column) -> Column:
    """What all ranges of a group hold. As bounds are compared one by one, partial results suffice."""
    lo = F.max(F.when(r["lo"].isNotNull(), F.struct(r["lo"].alias("v"), (~r["lo_inc"]).alias("open"))))
    hi = F.min(F.when(r["hi"].isNotNull(), F.struct(r["hi"].alias("v"), r["hi_inc"].alias("inc"))))
    none = F.bool_or(r["empty"])
    a, b, x, y = lo["v"], hi["v"], ~lo["open"], hi["inc"]
    empty = F.coalesce(none | (a > b) | ((a == b) & ~(x & y)), none)
    return F.when(F.count(r) > 0, _make(a, b, F.coalesce(x, F.lit(False)), F.coalesce(y, F.lit(False)), empty))
