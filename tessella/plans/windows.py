"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import windows as W
from tessella.plans.registry import query, statement
from tessella.session import table

O = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
statement("win_ranking", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nt FROM part")
statement("win_distribution", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part")
statement("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {O} AS p, lead(o_totalprice, 2) {O} AS n2, lag(o_orderkey, 1, -1) {O} AS d FROM orders")
statement("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
statement("win_running", f"SELECT o_orderkey, round(sum(o_totalprice) {O}, 2) AS s, count(*) {O} AS c, max(o_totalprice) {O} AS m FROM orders")
statement("win_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
statement("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
statement("win_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
statement("win_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM events) e", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM events) e")
statement("win_share", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 9) AS share FROM supplier")


@query("win_groups_frame", "SELECT p_partkey, sum(p_retailprice::DECIMAL(12, 2)) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::DOUBLE AS s FROM part")
def win_groups_frame(spark, d):
    p = table(spark, d, "part").withColumn("v", F.col("p_retailprice").cast("decimal(12,2)"))
    return W.groups_frame(p, ["p_brand"], ["p_size"], {"s": F.sum("v")}, 1, 1).select("p_partkey", F.col("s").cast("double").alias("s"))


@query("win_exclude_current", "SELECT s_suppkey, sum(s_nationkey) OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS s FROM supplier")
def win_exclude_current(spark, d):
    w = Window.partitionBy(F.col("s_nationkey") % 5).orderBy("s_suppkey").rowsBetween(-2, 2)
    return table(spark, d, "supplier").select("s_suppkey", W.excluded("current row", "sum", F.col("s_nationkey").cast("long"), w).alias("s"))


_EX = "OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE {})"
_V = "CASE WHEN p_partkey % 3 > 0 THEN p_size END"


@query("win_exclude_peers", "SELECT p_partkey, " + ", ".join(f"{a}({_V}) {_EX.format(k)}{c} AS {a}_{k}" for k in ("ties", "group") for a, c in (("sum", "::BIGINT"), ("count", ""))) + f", round(avg({_V}) {_EX.format('ties')}, 9) AS avg_ties FROM part")
def win_exclude_peers(spark, d):
    v = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).cast("long")
    w, peers = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5), Window.partitionBy("p_brand", "p_size")
    cols = [W.excluded(k, a, v, w, peers).alias(f"{a}_{k}") for k in ("ties", "group") for a in ("sum", "count")]
    return table(spark, d, "part").select("p_partkey", *cols, F.round(W.excluded("ties", "avg", v, w, peers), 9).alias("avg_ties"))


@query(
    "win_interpolate",
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1
      FROM e WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS v FROM n""",
)
def win_interpolate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return table(spark, d, "events").select("event_id", F.round(W.interpolate(v, w), 6).alias("v"))


@query(
    "win_moving",
    "SELECT event_id, round(avg(value) OVER w, 6) AS a, round(sum(value) OVER w, 6) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
)
def win_moving(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(W.moving_avg(v, 5, w), 6).alias("a"), F.round(W.moving_sum(v, 5, w), 6).alias("s"))


@query(
    "win_delta_rate",
    "SELECT event_id, round(value - lag(value) OVER w, 6) AS d, round((value - lag(value) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 9) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def win_delta_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(W.delta(v, w), 6).alias("d"), F.round(W.rate(v, F.col("ts"), w), 9).alias("r"))
