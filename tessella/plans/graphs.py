"""Recursion with duplicates removed, walks and shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graphs as G
from tessella.plans.registry import query
from tessella.session import table

EDGES = "(VALUES (1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 0.5), (4, 2, 1.0), (4, 5, 3.0), (3, 5, 3.5), (6, 1, 1.0), (5, 1, 9.0))"
WALKS = f"WITH RECURSIVE g(node_id, depth, path) AS (SELECT 1, 0, [1] UNION ALL SELECT e.d, depth + 1, list_append(path, e.d) FROM g JOIN {EDGES} AS e(s, d, w) ON e.s = node_id WHERE NOT list_contains(path, e.d) AND depth < 100) SELECT node_id, depth, path FROM g"
MAILS = "SELECT c_custkey AS src, unnest([(c_custkey * 2) % n + 1, (c_custkey * 2 + 1) % n + 1]) AS dst FROM customer, (SELECT count(*) AS n FROM customer)"


def edges(spark):
    return spark.sql(f"SELECT s AS src, d AS dst, CAST(w AS double) AS w FROM {EDGES} AS t(s, d, w)")


@query("graph_bfs", WALKS)
def graph_bfs(spark, d):
    return G.bfs(edges(spark), 1)


@query("graph_dfs", WALKS)
def graph_dfs(spark, d):
    return G.dfs(edges(spark), 1)


_SHORT = f"WITH RECURSIVE g(node_id, total_cost, path) AS (SELECT 1, 0.0::DOUBLE, [1] UNION ALL SELECT e.d, total_cost + e.w, list_append(path, e.d) FROM g JOIN {EDGES} AS e(s, d, w) ON e.s = node_id WHERE NOT list_contains(path, e.d)), b AS (SELECT node_id, min(total_cost) AS c FROM g GROUP BY 1) SELECT g.* FROM g JOIN b ON g.node_id = b.node_id AND total_cost = c"


@query("graph_shortest_path", _SHORT)
def graph_shortest_path(spark, d):
    return G.shortest_paths(edges(spark), 1, weight="w")


@query("graph_shortest_path_to", f"SELECT * FROM ({_SHORT}) WHERE node_id = 5")
def graph_shortest_path_to(spark, d):
    return G.shortest_paths(edges(spark), 1, 5, weight="w")


def mails(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    ends = F.array((F.col("c_custkey") * 2) % F.col("n") + 1, (F.col("c_custkey") * 2 + 1) % F.col("n") + 1)
    return c.crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("src"), F.explode(ends).alias("dst"))


@query("graph_reach", f"WITH RECURSIVE e AS ({MAILS}), r(node_id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = node_id WHERE depth < 25) SELECT node_id, min(depth)::INT AS depth FROM r GROUP BY 1")
def graph_reach(spark, d):
    return G.reach(mails(spark, d), 5, max_depth=25)


@query("recursive_union_distinct", f"WITH RECURSIVE e AS ({MAILS}), r(k) AS (SELECT 5::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = k) SELECT k FROM r")
def recursive_union_distinct(spark, d):
    e = mails(spark, d)
    return G.recursive_union(spark.sql("SELECT 5L AS k"), lambda r: r.join(e, r.k == e.src).select(F.col("dst").alias("k")))


@query("recursive_search_cycle", f"WITH RECURSIVE t(k, cycle_path, depth, is_cycle) AS (SELECT 1, [1], 0, false UNION ALL SELECT e.d, list_append(cycle_path, e.d), depth + 1, list_contains(cycle_path, e.d) FROM t JOIN {EDGES} AS e(s, d, w) ON e.s = t.k WHERE NOT is_cycle) SELECT k, cycle_path, is_cycle, row_number() OVER (ORDER BY cycle_path) AS n FROM t")
def recursive_search_cycle(spark, d):
    from pyspark.sql import Window

    out = G.recursive_search(spark.sql("SELECT 1 AS k"), edges(spark), "k", "src", "dst", "depth", True)
    return out.select("k", "cycle_path", "is_cycle", F.row_number().over(Window.orderBy("ordercol")).alias("n"))


@query("recursive_search_breadth", "SELECT * FROM (VALUES (1, 0, 1), (2, 1, 2), (3, 1, 3), (4, 2, 4), (5, 2, 5), (6, 3, 6)) t(k, depth, n)")
def recursive_search_breadth(spark, d):
    from pyspark.sql import Window

    tree = spark.sql("SELECT * FROM VALUES (1, 3), (1, 2), (3, 5), (2, 4), (4, 6) AS t(src, dst)")
    out = G.recursive_search(spark.sql("SELECT 1 AS k"), tree, "k", "src", "dst", "breadth")
    return out.select("k", "depth", F.row_number().over(Window.orderBy("ordercol")).alias("n"))
