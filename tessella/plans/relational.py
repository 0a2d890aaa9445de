"""Scans, projections, filters, joins, set operations, sort and limit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import joins
from tessella.plans.registry import query, statement
from tessella.session import scratch, table


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count(F.lit(1)).alias("n"),
    )


# scans and projections
statement("seq_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
statement("filter_pushdown", "SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05 AND l_returnflag = 'R'")
statement("bitmap_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 100000")
statement("projection_arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
statement("result_constant", "SELECT 1 AS a, 'x' AS b, 2.5D AS c", "SELECT 1 AS a, 'x' AS b, 2.5::DOUBLE AS c")
statement("values_scan", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, v)")
statement("one_time_filter", "SELECT n_nationkey FROM nation WHERE 1 = 2")
statement("generate_series", "SELECT id FROM (SELECT explode(sequence(2, 40, 3)) AS id)", "SELECT generate_series::INT AS id FROM generate_series(2, 40, 3)")
statement("project_set", "SELECT n_nationkey, explode(sequence(1, n_regionkey + 1)) AS k FROM nation", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1))::INT AS k FROM nation")
statement("srf_lockstep", "SELECT inline(arrays_zip(array(1, 2, 3), array('x', 'y'))) AS (a, b)", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
statement("with_ordinality", "SELECT o_orderkey, pos + 1 AS ord, w FROM orders LATERAL VIEW posexplode(split(o_orderpriority, '-')) t AS pos, w", "SELECT o_orderkey, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1))::INT AS ord, unnest(string_split(o_orderpriority, '-')) AS w FROM orders")

# predicates
statement("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
statement("case_simple", "SELECT l_returnflag, sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
statement("between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
statement("any_array", "SELECT n_name FROM nation WHERE array_contains(array(1, 3), n_regionkey)", "SELECT n_name FROM nation WHERE n_regionkey = ANY([1, 3])")
statement("all_array", "SELECT n_name FROM nation WHERE forall(array(1, 3), x -> n_regionkey > x)", "SELECT n_name FROM nation WHERE n_regionkey > ALL(SELECT unnest([1, 3]))")
statement("is_distinct_from", "SELECT a, b, NOT (a <=> b) AS d FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS t(a, b)", "SELECT a, b, a IS DISTINCT FROM b AS d FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS t(a, b)")
statement("three_valued", "SELECT a, a IS NULL AS n, a IS TRUE AS t, a IS NOT FALSE AS nf, a IS UNKNOWN AS u FROM (VALUES (true), (false), (CAST(NULL AS boolean))) AS v(a)", "SELECT a, a IS NULL AS n, coalesce(a, false) AS t, coalesce(a, true) AS nf, a IS NULL AS u FROM (VALUES (true), (false), (CAST(NULL AS boolean))) AS v(a)")
statement("row_in", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 8), (4, 4))")
statement("like_ilike", "SELECT p_partkey, p_name LIKE '%a_e%' AS l, p_name ILIKE '%GREEN%' AS i, p_name NOT LIKE 'b%' AS n FROM part")
statement("regex_match", "SELECT p_partkey, p_type RLIKE '^[A-Z]+ .*(TIN|STEEL)$' AS m, NOT p_name RLIKE '(?i)RED' AS nm FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+ .*(TIN|STEEL)$') AS m, NOT regexp_matches(p_name, '(?i)RED') AS nm FROM part")
statement("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
statement("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
statement("not_in_null", "SELECT x FROM (VALUES (1), (2), (NULL)) AS a(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (NULL)) AS b(y))")
statement("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
statement("uncorrelated_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")

# joins
statement("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
statement("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
statement("join_right", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON o_custkey = c_custkey AND c_acctbal > 5000")
statement("join_full", "SELECT s_suppkey, c_custkey FROM supplier s FULL JOIN customer c ON s_suppkey = c_custkey")
statement("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("join_natural_using", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b")
statement("join_using", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
statement("join_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
statement("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
statement("join_theta", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
statement("join_multiway", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name")
statement("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("join_null_safe", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (3)) a(x) JOIN (VALUES (1), (NULL)) b(x) ON a.x <=> b.x", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (3)) a(x) JOIN (VALUES (1), (NULL)) b(x) ON a.x IS NOT DISTINCT FROM b.x")


@query("join_lateral", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def join_lateral(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.lateral_first(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_custkey", [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")], 2).select("c_custkey", "o_orderkey")


@query("join_range", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice >= s_acctbal * 20 AND o_totalprice < s_acctbal * 20 + 4000")
def join_range(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 20).alias("low"), (F.col("s_acctbal") * 20 + 4000).alias("high"))
    return joins.range_join(table(spark, d, "orders"), s, "o_totalprice", "low", "high", 4000.0).select("o_orderkey", "s_suppkey")


@query(
    "join_asof",
    """SELECT p.event_id, p.user_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def join_asof(spark, d):
    e = table(spark, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return joins.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "user_id", "click_id")


@query("join_salted", "SELECT l_returnflag, count(*) AS n, round(sum(p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag")
def join_salted(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_returnflag")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_retailprice")
    return joins.salted_join(li, p, ["k"], 4).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("v"))


@query("not_in_filter", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_filter(spark, d):
    return joins.not_in(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey"), "o_custkey").select("c_custkey")


# set operations
A, B = "(SELECT c_nationkey AS k FROM customer)", "(SELECT s_nationkey AS k FROM supplier)"
for _name, _op in {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    statement(f"set_{_name}", f"SELECT k FROM {A} a {_op} SELECT k FROM {B} b")
statement("set_nested", "SELECT n_regionkey AS k FROM nation UNION (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")

# sort, limit, distinct
statement("sort_nulls", "SELECT x FROM (VALUES (3), (NULL), (1)) t(x) ORDER BY x ASC NULLS LAST LIMIT 2")
statement("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 15")
statement("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
statement("merge_append", "SELECT k, src FROM (SELECT s_suppkey AS k, 's' AS src FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation) ORDER BY k, src", "SELECT k, src FROM (SELECT s_suppkey AS k, 's' AS src FROM supplier UNION ALL SELECT n_nationkey::BIGINT, 'n' FROM nation) ORDER BY k, src")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct((-F.col("o_totalprice")).alias("a"), F.col("o_orderkey").alias("b")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("fetch_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
def fetch_with_ties(spark, d):
    # the value of the tenth row bounds the result: a bounded top-n and a filter, no global window
    p = table(spark, d, "part").select("p_partkey", "p_size")
    last = p.orderBy(F.col("p_size").desc()).limit(10).agg(F.min("p_size").alias("least"))
    return p.join(F.broadcast(last), F.col("p_size") >= F.col("least")).drop("least")


# common table expressions and recursion
statement("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey WHERE n > 2")
statement("recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
statement("recursive_path", "WITH RECURSIVE t(k, path) AS (SELECT 0, array(0) UNION ALL SELECT e.b, array_append(path, e.b) FROM t JOIN (VALUES (0, 1), (1, 2), (0, 2), (2, 3), (3, 0)) AS e(a, b) ON e.a = t.k WHERE NOT array_contains(path, e.b)) SELECT k, array_join(path, '>') AS path FROM t", "WITH RECURSIVE t(k, path) AS (SELECT 0, [0] UNION ALL SELECT e.b, list_append(path, e.b) FROM t JOIN (VALUES (0, 1), (1, 2), (0, 2), (2, 3), (3, 0)) AS e(a, b) ON e.a = t.k WHERE NOT list_contains(path, e.b)) SELECT k, array_to_string(path, '>') AS path FROM t")


@query("partition_pruning", "SELECT o_orderstatus, year(o_orderdate)::INT AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY ALL")
def partition_pruning(spark, d):
    path = scratch(spark, "orders")
    table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).repartition("y").write.partitionBy("y").parquet(path)
    # only the folders of these years are listed and read
    return spark.read.parquet(path).filter("y >= 1997").groupBy("o_orderstatus", "y").agg(F.count(F.lit(1)).alias("n"))


@query("group_functional_dependency", "SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment")
def group_functional_dependency(spark, d):
    # orders fold to one row a customer before they meet the wide side
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))


@query("pivot_crosstab", "SELECT c_mktsegment, count(*) FILTER (n_regionkey = 0) AS r0, count(*) FILTER (n_regionkey = 1) AS r1, count(*) FILTER (n_regionkey = 2) AS r2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def pivot_crosstab(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = j.groupBy("c_mktsegment").pivot("n_regionkey", [0, 1, 2]).count().na.fill(0)
    return out.select("c_mktsegment", *[F.col(str(i)).alias(f"r{i}") for i in range(3)])


@query("unpivot", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "metric", "v")


@query("topn_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topn_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey")
