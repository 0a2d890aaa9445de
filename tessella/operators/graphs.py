"""Recursion with duplicates removed, and walks over a table of edges. Every round ends at a written table, so that plans
stay small and rounds survive lost executors; only counts come to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: ``step`` of the rows that the last round added, until none is new. Nulls count as equal."""
    fresh = materialize(base.distinct(), "round")
    parts = [fresh]
    for _ in range(max_rounds):
        if not fresh.limit(1).count():
            break
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        if len(parts) > 8:  # many small rounds become one table
            seen = materialize(seen, "seen")
            parts = [seen]
        fresh = materialize(step(fresh).select(*base.columns).distinct().subtract(seen), "round")
        parts.append(fresh)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walks(edges: DataFrame, start, src: str = "src", dst: str = "dst", max_depth: int = 100) -> DataFrame:
    """node_id, depth, path of every walk from ``start`` that visits no node twice: a node comes once for
    each such path, as the number of them asks. For the nodes alone see ``reach``."""
    spark = edges.sparkSession
    kind = edges.schema[dst].dataType
    fresh = spark.range(1).select(F.lit(start).cast(kind).alias("node_id"), F.lit(0).alias("depth"), F.array(F.lit(start).cast(kind)).alias("path"))
    out = fresh
    e = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).filter(F.col("__d").isNotNull())
    for _ in range(max_depth):
        step = fresh.join(e, F.col("node_id") == F.col("__s")).filter(~F.array_contains("path", F.col("__d")))
        fresh = materialize(step.select(F.col("__d").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("__d")).alias("path")), "walks")
        if not fresh.limit(1).count():
            break
        out = out.unionByName(fresh)
    return out


def bfs(edges: DataFrame, start, src: str = "src", dst: str = "dst", max_depth: int = 100) -> DataFrame:
    """The walks, by depth, then node."""
    return walks(edges, start, src, dst, max_depth).orderBy("depth", "node_id")


def dfs(edges: DataFrame, start, src: str = "src", dst: str = "dst", max_depth: int = 100) -> DataFrame:
    """The same walks, by path."""
    return walks(edges, start, src, dst, max_depth).orderBy("path")


def reach(edges: DataFrame, start, src: str = "src", dst: str = "dst", max_depth: int = 1000) -> DataFrame:
    """node_id and least depth of the nodes that ``start`` reaches: each node is looked at once, so the work grows
    with the edges and not with the paths."""
    spark = edges.sparkSession
    kind = edges.schema[dst].dataType
    fresh = materialize(spark.range(1).select(F.lit(start).cast(kind).alias("node_id"), F.lit(0).alias("depth")), "reach")
    seen = fresh
    e = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).filter(F.col("__d").isNotNull())
    for depth in range(1, max_depth + 1):
        step = e.join(fresh.select(F.col("node_id").alias("__s")), "__s", "left_semi").select(F.col("__d").alias("node_id")).distinct()
        fresh = materialize(step.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if not fresh.limit(1).count():
            break
        seen = materialize(seen.unionByName(fresh), "seen")
    return seen


def shortest_paths(edges: DataFrame, start, end=None, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """node_id, total_cost and path of the cheapest walks from ``start``: all that tie. Weights aren't negative.

    Costs are relaxed round by round, one row a node, until none falls; then paths are put together from
    edges that lie on a cheapest one only, so other paths are never listed.
    """
    spark = edges.sparkSession
    kind = edges.schema[dst].dataType
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    e = edges.select(F.col(src).cast(kind).alias("__s"), F.col(dst).alias("__d"), w.alias("__w")).filter("__s is not null and __d is not null and __w is not null")
    if e.filter("__w < 0").limit(1).count():
        raise ValueError("negative weights")
    e = materialize(e.groupBy("__s", "__d").agg(F.min("__w").alias("__w")), "edges")
    cost = materialize(spark.range(1).select(F.lit(start).cast(kind).alias("node_id"), F.lit(0.0).alias("cost")), "cost")
    fresh = cost
    while fresh.limit(1).count():
        step = fresh.join(e, F.col("node_id") == F.col("__s")).groupBy(F.col("__d").alias("node_id")).agg(F.min(F.col("cost") + F.col("__w")).alias("new"))
        fresh = materialize(step.join(cost, "node_id", "left").filter("cost is null or new < cost").select("node_id", F.col("new").alias("cost")), "fresh")
        cost = materialize(cost.join(fresh.withColumnRenamed("cost", "new"), "node_id", "full").select("node_id", F.coalesce("new", "cost").alias("cost")), "cost")
    a, b = cost.select(F.col("node_id").alias("__s"), F.col("cost").alias("__a")), cost.select(F.col("node_id").alias("__d"), F.col("cost").alias("__b"))
    tight = materialize(e.join(a, "__s").join(b, "__d").filter("__a + __w = __b").select("__s", "__d", "__b"), "tight")
    if end is not None:  # edges that lead to the end only
        back = tight.select(F.col("__d").alias("src"), F.col("__s").alias("dst"))
        on = reach(back, end).select("node_id")
        tight = tight.join(on.withColumnRenamed("node_id", "__d"), "__d", "left_semi")
    fresh = spark.range(1).select(F.lit(start).cast(kind).alias("node_id"), F.lit(0.0).alias("total_cost"), F.array(F.lit(start).cast(kind)).alias("path"))
    out = fresh
    while True:
        step = fresh.join(tight, F.col("node_id") == F.col("__s")).filter(~F.array_contains("path", F.col("__d")))
        fresh = materialize(step.select(F.col("__d").alias("node_id"), F.col("__b").alias("total_cost"), F.concat("path", F.array("__d")).alias("path")), "paths")
        if not fresh.limit(1).count():
            break
        out = out.unionByName(fresh)
    return out if end is None else out.filter(F.col("node_id") == F.lit(end))


def recursive_search(base: DataFrame, edges: DataFrame, key: str, src: str, dst: str, search: str | None = None, cycle: bool = False, max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION ALL along edges with SEARCH and CYCLE: ``ordercol`` (depth first: the keys on the way;
    breadth first: depth and key), ``is_cycle`` and ``cycle_path``. A row that closes a cycle is given and not followed."""
    first: list[Column] = [F.col(key)]
    fresh = base.select(*first, F.array(key).alias("cycle_path"), F.lit(0).alias("depth"), F.lit(False).alias("is_cycle"))
    out = fresh
    e = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
    for _ in range(max_rounds):
        step = fresh.filter("not is_cycle").join(e, F.col(key) == F.col("__s"))
        fresh = materialize(step.select(F.col("__d").alias(key), F.concat("cycle_path", F.array("__d")).alias("cycle_path"), (F.col("depth") + 1).alias("depth"), F.array_contains("cycle_path", F.col("__d")).alias("is_cycle")), "search")
        if not fresh.limit(1).count():
            break
        if not cycle and fresh.filter("is_cycle").limit(1).count():
            raise RuntimeError("the edges have a cycle: ask for CYCLE")
        out = out.unionByName(fresh)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if search == "depth":
        out = out.withColumn("ordercol", F.col("cycle_path"))
    elif search == "breadth":
        out = out.withColumn("ordercol", F.struct("depth", key))
    return out if cycle else out.drop("is_cycle")
