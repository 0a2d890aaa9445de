"""Functions of users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import programs as P
from tessella.plans.registry import query, views
from tessella.session import table

c = F.col


@query("udf_sql_function", "SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders")
def udf_sql_function(spark, d):
    P.create_function(spark, "gross", "x DOUBLE, rate DOUBLE DEFAULT 0.19", "DOUBLE", "round(x * (1 + rate), 4)")
    views(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, gross(o_totalprice) AS gross FROM orders")


@query("udf_sql_table_function", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 2")
def udf_sql_table_function(spark, d):
    views(spark, d, "orders customer")
    P.create_function(spark, "orders_of", "k BIGINT", "TABLE (o_orderkey BIGINT)", "SELECT o_orderkey FROM orders WHERE o_custkey = k")
    return spark.sql("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL orders_of(c_custkey) t WHERE c_nationkey = 2")


@query("udf_script_block", "SELECT 5050::BIGINT AS total, 100::INT AS n")
def udf_script_block(spark, d):
    return P.do(spark, """
      DECLARE total BIGINT DEFAULT 0;
      DECLARE n INT DEFAULT 0;
      WHILE n < 100 DO
        SET n = n + 1;
        SET total = total + n;
      END WHILE;
      IF total > 5000 THEN SELECT total AS total, n AS n; ELSE SELECT 0L AS total, 0 AS n; END IF;
    """)


@query("udf_procedure", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 2")
def udf_procedure(spark, d):
    ps = P.Procedures()
    ps.create("large_nations", lambda s, least: table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > least))
    return ps.call(spark, "large_nations", 2)


@query("udf_python", "SELECT p_partkey, length(p_name) * 2 AS n FROM part")
def udf_python(spark, d):
    def twice(s: pd.Series) -> pd.Series:
        return s.str.len() * 2

    return table(spark, d, "part").select("p_partkey", P.python_function(twice, "long")("p_name").alias("n"))


@query("udf_aggregate", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS sq, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1")
def udf_aggregate(spark, d):
    rms = P.composed_aggregate({"s": lambda x: F.avg(x * x)}, lambda s: F.sqrt(s))
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.sum(c("l_quantity") * c("l_quantity")), 2).alias("sq"), F.round(rms(c("l_quantity")), 6).alias("rms"))


@query("udf_python_aggregate", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def udf_python_aggregate(spark, d):
    spread = P.python_aggregate(lambda x: float(x.max() - x.min()), "double")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("spread"))


@query("udf_moving_aggregate", "SELECT o_orderkey, round(sqrt(avg(o_totalprice * o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), 4) AS rms FROM orders")
def udf_moving_aggregate(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    rms = P.composed_aggregate({"s": lambda x: F.avg(x * x).over(w)}, lambda s: F.sqrt(s))
    return table(spark, d, "orders").select("o_orderkey", F.round(rms(c("o_totalprice")), 4).alias("rms"))


@query("udf_window", "SELECT s_suppkey, round(max(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal, 4) AS gap FROM supplier")
def udf_window(spark, d):
    top = P.python_aggregate(lambda x: float(x.max()), "double")
    return table(spark, d, "supplier").select("s_suppkey", F.round(top("s_acctbal").over(Window.partitionBy("s_nationkey")) - c("s_acctbal"), 4).alias("gap"))


@query("udf_table_function", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1))::INT AS i, n_regionkey * unnest(generate_series(1, n_regionkey + 1))::INT AS v FROM nation")
def udf_table_function(spark, d):
    P.table_function(spark, "multiples", lambda n: ((i, n * i) for i in range(1, n + 2)), "i int, v int")
    views(spark, d, "nation")
    return spark.sql("SELECT n_nationkey, t.i, t.v FROM nation, LATERAL multiples(CAST(n_regionkey AS int)) t")


@query("udf_rows_from", "SELECT * FROM (VALUES (1, 'a', 1), (2, 'b', 2), (3, NULL, 3)) t(c1, c2, ordinality)")
def udf_rows_from(spark, d):
    return spark.range(1).select(P.rows_from(F.lit([1, 2, 3]), F.lit(["a", "b"])))
