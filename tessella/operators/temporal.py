"""Tables with a history: states at a time, versions between times, and constraints over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(changes: DataFrame, key: list[str], at: str, deleted: str | None = None) -> DataFrame:
    """From changes of rows (the row as it is from ``at`` on; ``deleted`` marks the end) to versions with row_start and
    row_end, null where a version still holds."""
    end = F.lead(at).over(Window.partitionBy(*key).orderBy(at))
    out = changes.withColumn("row_start", F.col(at)).withColumn("row_end", end).drop(at)
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def as_of(versions: DataFrame, at) -> DataFrame:
    """The rows as they were: row_start <= at < row_end."""
    at = at if isinstance(at, Column) else F.lit(at)
    return versions.filter((F.col("row_start") <= at) & (F.col("row_end").isNull() | (F.col("row_end") > at)))


def versions_between(versions: DataFrame, low, high) -> DataFrame:
    """Versions that held at some time from low to high."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return versions.filter((F.col("row_start") <= high) & (F.col("row_end").isNull() | (F.col("row_end") > low)))


def overlapping(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Rows whose period meets that of an earlier one of the same key: what WITHOUT OVERLAPS refuses. A window looks at the
    latest end so far, so no pairs are made. A null end is open."""
    far = F.lit("9999-12-31 23:59:59").cast(df.schema[end].dataType) if df.schema[end].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.lit((1 << 62)).cast(df.schema[end].dataType)
    w = Window.partitionBy(*key).orderBy(start, F.coalesce(F.col(end), far)).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.coalesce(F.col(end), far)).over(w)
    return df.withColumn("__latest", latest).filter((F.col("__latest") > F.col(start)) & (F.coalesce(F.col(end), far) > F.col(start))).drop("__latest")


def uncovered(child: DataFrame, parent: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Child rows whose period the parent's periods of the same key don't cover whole: what a temporal foreign key
    refuses. Parent periods are merged first; ends aren't null."""
    w = Window.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("__seen") >= F.col(start), 0).otherwise(1)).over(w)
    merged = parent.select(*key, start, end).withColumn("__seen", seen).withColumn("__island", island).groupBy(*key, "__island").agg(F.min(start).alias("__ps"), F.max(end).alias("__pe")).drop("__island")
    covers = child.join(merged, key).filter((F.col("__ps") <= F.col(start)) & (F.col("__pe") >= F.col(end))).select(*child.columns).distinct()
    return child.join(covers, child.columns, "left_anti")
