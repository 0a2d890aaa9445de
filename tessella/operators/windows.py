"""Frames and window functions beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str], aggs: dict[str, Column], before: int, after: int) -> DataFrame:
    """``GROUPS BETWEEN before PRECEDING AND after FOLLOWING``: a range over the number of the peer group."""
    g = "__group"
    ranked = df.withColumn(g, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy(g).rangeBetween(-before, after)
    return ranked.withColumns({k: v.over(w) for k, v in aggs.items()}).drop(g)


def excluded(kind: str, aggregate: str, value: Column, frame: WindowSpec, peers: WindowSpec | None = None) -> Column:
    """sum, count or avg over a frame with EXCLUDE ``kind``: ``current row``, ``group`` or ``ties``. sum and avg are null where
    nothing is left. ``peers``: the window of the row's peers, which the frame must hold whole, as RANGE and GROUPS
    frames around the row do; frames that cut peer groups (ROWS) serve ``current row`` only."""
    own, has = F.coalesce(value, F.lit(0)), F.when(value.isNull(), 0).otherwise(1)
    total, n = F.coalesce(F.sum(value).over(frame), F.lit(0)), F.count(value).over(frame)
    if kind == "current row":
        total, n = total - own, n - has
    elif kind in ("group", "ties"):
        total, n = total - F.coalesce(F.sum(value).over(peers), F.lit(0)), n - F.count(value).over(peers)
        if kind == "ties":
            total, n = total + own, n + has
    else:
        raise ValueError(f"EXCLUDE {kind}")
    if aggregate == "count":
        return n
    return F.when(n > 0, total if aggregate == "sum" else total / n)


def interpolate(value: Column, w: WindowSpec) -> Column:
    """Linear between the nearest values before and after, by position of the row; the nearest
    one at the ends; null in a partition without any."""
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    i = F.row_number().over(w)
    at = F.when(value.isNotNull(), i)
    v0, i0 = F.last(value, True).over(back), F.last(at, True).over(back)
    v1, i1 = F.first(value, True).over(ahead), F.first(at, True).over(ahead)
    line = v0 + (v1 - v0) * (i - i0) / F.nullif(i1 - i0, F.lit(0))
    return F.coalesce(value.cast("double"), line, v0.cast("double"), v1.cast("double"))


def locf(value: Column, w: WindowSpec) -> Column:
    """The last value that isn't null, up to here."""
    return F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def moving_avg(value: Column, n: int, w: WindowSpec) -> Column:
    return F.avg(value).over(w.rowsBetween(-(n - 1), 0))


def moving_sum(value: Column, n: int, w: WindowSpec) -> Column:
    return F.sum(value).over(w.rowsBetween(-(n - 1), 0))


def delta(value: Column, w: WindowSpec) -> Column:
    return value - F.lag(value).over(w)


def rate(value: Column, at: Column, w: WindowSpec) -> Column:
    """Change a second; null on the first row, with nulls, or where no time has passed."""
    micros = F.unix_micros(at.cast("timestamp"))
    return delta(value, w) / F.nullif((micros - F.lag(micros).over(w)) / F.lit(1e6), F.lit(0.0))
