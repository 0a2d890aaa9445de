"""Aggregates that Spark has no name for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hypothetical(value: float, col: Column) -> dict[str, Column]:
    """What the rank functions would give for ``value`` as one more row of the group, ascending.
    One pass and partial aggregation; nulls sort last and so never come before the value."""
    v = F.lit(value)
    before, upto, n = F.count_if(col < v), F.count_if(col <= v), F.count(F.lit(1))
    return {
        "rank": before + 1,
        "dense_rank": F.count_distinct(F.when(col < v, col)) + 1,
        "percent_rank": F.when(n > 0, before / n).otherwise(F.lit(0.0)),
        "cume_dist": (upto + 1) / (n + 1),
    }


def first_by(value: Column, at: Column) -> Column:
    """The value at the least time; rows without value or time don't count."""
    ok = value.isNotNull() & at.isNotNull()
    return F.min_by(F.when(ok, value), F.when(ok, at))


def last_by(value: Column, at: Column) -> Column:
    ok = value.isNotNull() & at.isNotNull()
    return F.max_by(F.when(ok, value), F.when(ok, at))


def ordered_list(value: Column, *by: Column) -> Column:
    """``array_agg(value ORDER BY by)``, nulls kept: one sort of each group's list."""
    rows = F.sort_array(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def ordered_text(value: Column, separator: str, *by: Column) -> Column:
    """``string_agg(value, separator ORDER BY by)``; nulls are passed by, none at all gives null."""
    text = F.array_join(ordered_list(value, *by), separator)
    return F.when(F.count(value) > 0, text)


def grouping_product(rollups: list[list[str]]) -> list[tuple[str, ...]]:
    """The grouping sets of several ROLLUPs side by side, each once (GROUP BY DISTINCT)."""
    sets: list[frozenset] = [frozenset()]
    for r in rollups:
        sets = [s | frozenset(r[:n]) for s in sets for n in range(len(r), -1, -1)]
    names = [c for r in rollups for c in r]
    order = list(dict.fromkeys(names))
    return [tuple(c for c in order if c in s) for s in dict.fromkeys(sets)]
