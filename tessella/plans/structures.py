"""Trees, cross tables, period folders, references, large objects, encryption."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import structures as S
from tessella.plans.registry import expect, query, statement
from tessella.session import scratch, table

c, f = F.col, F.lit


@query("tree_connect_by", expect("key, parent, level, branch, serial", ("row2", None, 0, "row2", 1), ("row4", "row2", 1, "row2~row4", 2), ("row6", "row4", 2, "row2~row4~row6", 3), ("row8", "row6", 3, "row2~row4~row6~row8", 4), ("row5", "row2", 1, "row2~row5", 5), ("row9", "row5", 2, "row2~row5~row9", 6)))
def tree_connect_by(spark, d):
    t = spark.sql("SELECT * FROM VALUES ('row1', NULL), ('row2', 'row1'), ('row3', 'row1'), ('row4', 'row2'), ('row5', 'row2'), ('row6', 'row4'), ('row7', 'row3'), ('row8', 'row6'), ('row9', 'row5') AS t(k, p)")
    return S.connect_by(t, "k", "p", "row2")


@query("crosstab_positions", "SELECT c_mktsegment, v[1] AS category_1, v[2] AS category_2, v[3] AS category_3 FROM (SELECT c_mktsegment, list(n ORDER BY c_nationkey) AS v FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_nationkey % 3 = 0 GROUP BY ALL) GROUP BY 1)")
def crosstab_positions(spark, d):
    n = table(spark, d, "customer").filter("c_nationkey % 3 = 0").groupBy("c_mktsegment", "c_nationkey").agg(F.count(f(1)).alias("n"))
    return S.crosstab(n, "c_mktsegment", "c_nationkey", "n", 3)


@query("crosstab_categories", "SELECT c_mktsegment, max(c_acctbal) FILTER (c_nationkey = 1) AS \"1\", max(c_acctbal) FILTER (c_nationkey = 2) AS \"2\" FROM customer GROUP BY 1")
def crosstab_categories(spark, d):
    return S.crosstab_by(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", [1, 2])


@query("normal_rand", "SELECT 20000::BIGINT AS n, true AS mean_ok, true AS sd_ok")
def normal_rand(spark, d):
    return S.normal_rand(spark, 20_000, 5.0, 3.0, 11).agg(F.count(f(1)).alias("n"), (F.abs(F.avg("value") - 5) < 0.1).alias("mean_ok"), (F.abs(F.stddev("value") - 3) < 0.1).alias("sd_ok"))


@query("period_folders", "SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def period_folders(spark, d):
    s = S.PeriodFolders(spark, scratch(spark, "periods"), "o_orderdate", "yyyy")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    s.append(o.filter("o_orderkey % 2 = 0"))
    s.append(o.filter("o_orderkey % 2 = 1"))
    s.drop_before("1996")
    return s.read().groupBy("period").agg(F.count(f(1)).alias("n"))


@query("foreign_key_check", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def foreign_key_check(spark, d):
    return S.orphans(table(spark, d, "customer"), table(spark, d, "nation").filter("n_regionkey <> 2"), [("c_nationkey", "n_nationkey")]).select("c_custkey")


@query("change_stamps", "SELECT r_regionkey, 'ann' AS changed_by, '2024-01-01 12:00:00' AS changed_at FROM region")
def change_stamps(spark, d):
    r = S.stamped(table(spark, d, "region").select("r_regionkey"), "ann", f(dt.datetime(2024, 1, 1, 12)), "changed_by", "changed_at")
    return r.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query("large_objects", expect("id, whole, part", (1, 5000, "0102030405"), (2, 3, "")))
def large_objects(spark, d):
    pages = S.LargeObjects.put(spark, [(1, bytes(i % 256 for i in range(5000))), (2, b"abc")])
    whole = S.LargeObjects.get(pages).select("id", F.length("data").alias("whole"))
    part = S.LargeObjects.get(pages, 2049, 5).select("id", F.hex("data").alias("part"))
    return whole.join(part, "id", "left").select("id", "whole", F.coalesce("part", f("")).alias("part"))


statement("aes_round_trip", "SELECT p_partkey, CAST(aes_decrypt(aes_encrypt(p_name, '0123456789abcdef', 'GCM'), '0123456789abcdef', 'GCM') AS string) AS s FROM part", "SELECT p_partkey, p_name AS s FROM part")
statement("exclusive_ranges", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey = b.l_suppkey")
statement("nulls_ordering", "SELECT x, row_number() OVER (ORDER BY x DESC NULLS LAST) AS a, row_number() OVER (ORDER BY x ASC NULLS FIRST) AS b, row_number() OVER (ORDER BY x ASC NULLS LAST) AS c FROM (VALUES (3), (NULL), (1)) t(x)")
statement("row_comparison", "SELECT n_nationkey FROM nation WHERE named_struct('a', n_regionkey, 'b', n_nationkey) > named_struct('a', 2, 'b', 12)", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (2, 12)")
