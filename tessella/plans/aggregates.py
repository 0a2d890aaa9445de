"""Aggregation: plain, distinct, filtered, ordered-set, hypothetical, statistical, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregation as A
from tessella.plans.registry import query, statement
from tessella.session import table

statement("agg_plain", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(sum(l_quantity), 2) AS q, round(avg(l_tax), 8) AS t FROM lineitem")
statement("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_orderkey) AS m FROM lineitem WHERE l_quantity < 0")
statement("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
statement("agg_distinct_many", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag")
statement("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY o_orderpriority")
statement("agg_bool_bit", "SELECT n_regionkey, bool_and(n_nationkey > 2) AS a, bool_or(n_nationkey > 22) AS o, every(n_nationkey >= 0) AS e, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, bool_and(n_nationkey > 2) AS a, bool_or(n_nationkey > 22) AS o, bool_and(n_nationkey >= 0) AS e, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx FROM nation GROUP BY n_regionkey")
statement("agg_any_value", "SELECT c_nationkey, any_value(c_nationkey * 2) AS v FROM customer GROUP BY c_nationkey")
statement("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS gr, grouping(l_linestatus) AS gl, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS gr, grouping(l_linestatus)::TINYINT AS gl, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
statement("agg_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
statement("agg_cube", "SELECT c_mktsegment, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)")


def _distinct_sets() -> str:
    """GROUP BY DISTINCT ROLLUP (a, b), ROLLUP (a, c): the sets of the product, each once."""
    return ", ".join("(" + ", ".join(x) + ")" for x in A.grouping_product([["c_mktsegment", "c_nationkey"], ["c_mktsegment", "up"]]))


statement("agg_group_by_distinct", f"SELECT c_mktsegment, c_nationkey, up, count(*) AS n FROM (SELECT *, c_acctbal > 0 AS up FROM customer) t GROUP BY GROUPING SETS ({_distinct_sets()})", "SELECT c_mktsegment, c_nationkey, up, count(*) AS n FROM (SELECT *, c_acctbal > 0 AS up FROM customer) t GROUP BY GROUPING SETS ((), (c_mktsegment), (c_mktsegment, c_nationkey), (c_mktsegment, up), (c_mktsegment, c_nationkey, up))")
statement("agg_percentile", "SELECT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 6) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p90 FROM customer GROUP BY c_mktsegment")
statement("agg_mode", "SELECT n_regionkey, mode() WITHIN GROUP (ORDER BY s_nationkey) AS m FROM (SELECT 1 AS n_regionkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM supplier GROUP BY s_nationkey))) AND s_nationkey <= (SELECT min(k) FROM (SELECT s_nationkey AS k FROM supplier GROUP BY s_nationkey HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM supplier GROUP BY s_nationkey))))) GROUP BY n_regionkey")
statement(
    "agg_statistics",
    "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(stddev_samp(l_tax), 8) AS sds, round(variance(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_discount), 9) AS vs, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 8) AS cp, round(covar_samp(l_quantity, l_tax), 8) AS cs FROM lineitem GROUP BY l_returnflag",
)
statement(
    "agg_regression",
    "SELECT l_linestatus, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx FROM lineitem GROUP BY l_linestatus",
    "SELECT l_linestatus, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx FROM lineitem GROUP BY l_linestatus",
)
statement("agg_regression_sums", "SELECT round(regr_sxy(o_totalprice, o_custkey) / 1e6, 2) AS sxy, round(regr_syy(o_totalprice, o_custkey) / 1e9, 3) AS syy FROM orders")
statement("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("agg_min_max_by", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS top, min_by(o_orderkey, o_totalprice) AS low FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS top, arg_min(o_orderkey, o_totalprice) AS low FROM orders GROUP BY o_orderstatus")
statement("agg_group_only", "SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY l_suppkey, l_returnflag")
statement("agg_histogram", "SELECT width_bucket(o_totalprice, 0, 500000, 10) AS b, count(*) AS n FROM orders GROUP BY width_bucket(o_totalprice, 0, 500000, 10)", "SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000)::BIGINT + 1 END AS b, count(*) AS n FROM orders GROUP BY 1")


@query("agg_array_ordered", "SELECT o_custkey, to_json(array_agg(o_orderkey ORDER BY o_orderdate DESC, o_orderkey))::VARCHAR AS keys FROM orders GROUP BY o_custkey")
def agg_array_ordered(spark, d):
    keys = A.ordered_list(F.col("o_orderkey"), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(keys).alias("keys"))


@query("agg_hypothetical", "SELECT c_mktsegment, count(*) FILTER (c_acctbal < 5000) + 1 AS r, count(DISTINCT c_acctbal) FILTER (c_acctbal < 5000) + 1 AS dr, round(count(*) FILTER (c_acctbal < 5000) / count(*), 9) AS pr, round((count(*) FILTER (c_acctbal <= 5000) + 1) / (count(*) + 1), 9) AS cd FROM customer GROUP BY c_mktsegment")
def agg_hypothetical(spark, d):
    h = A.hypothetical(5000.0, F.col("c_acctbal"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(h["rank"].alias("r"), h["dense_rank"].alias("dr"), F.round(h["percent_rank"], 9).alias("pr"), F.round(h["cume_dist"], 9).alias("cd"))


@query("agg_first_last", "SELECT user_id, round(arg_min(value, ts), 6) AS first_value, round(arg_max(value, ts), 6) AS last_value FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY user_id, ts) GROUP BY user_id")
def agg_first_last(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return e.groupBy("user_id").agg(F.round(A.first_by(F.col("value"), F.col("ts")), 6).alias("first_value"), F.round(A.last_by(F.col("value"), F.col("ts")), 6).alias("last_value"))


@query("agg_conversation_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def agg_conversation_text(spark, d):
    line = F.concat_ws(": ", "role", "text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(A.ordered_text(line, "\n", F.col("turn"), F.col("role"), F.col("text")).alias("transcript"))


@query("agg_user_defined", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY l_returnflag")
def agg_user_defined(spark, d):
    """A user's aggregate (geometric mean) as a composition, so that it keeps partial aggregation."""
    geometric = lambda c: F.exp(F.avg(F.ln(c)))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(geometric(F.col("l_quantity")), 6).alias("g"))
