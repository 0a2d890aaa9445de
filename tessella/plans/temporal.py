"""History, states at a time, period constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import temporal as T
from tessella.plans.registry import query
from tessella.session import table

c = F.col
V = "(SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS row_start, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS row_end FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL))"


def versions(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))
    return T.history(o, ["o_custkey"], "o_orderdate")


def _day(s):
    return F.lit(s).cast("timestamp_ntz")


@query("temporal_as_of", f"SELECT o_custkey, o_orderkey FROM {V} WHERE row_start <= TIMESTAMP '1996-06-01' AND (row_end IS NULL OR row_end > TIMESTAMP '1996-06-01')")
def temporal_as_of(spark, d):
    return T.as_of(versions(spark, d), _day("1996-06-01")).select("o_custkey", "o_orderkey")


@query("temporal_versions_between", f"SELECT o_custkey, count(*) AS n FROM {V} WHERE row_start <= TIMESTAMP '1997-01-01' AND (row_end IS NULL OR row_end > TIMESTAMP '1996-01-01') GROUP BY 1")
def temporal_versions_between(spark, d):
    return T.versions_between(versions(spark, d), _day("1996-01-01"), _day("1997-01-01")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


P = "(SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 50 AS s, l_partkey % 50 + l_suppkey % 9 AS e FROM lineitem)"


def periods(spark, d):
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), (c("l_partkey") % 50).alias("s"), (c("l_partkey") % 50 + c("l_suppkey") % 9).alias("e"))


@query("temporal_without_overlaps", f"WITH p AS (SELECT *, row_number() OVER () AS rid FROM {P} WHERE s < e) SELECT k, true AS bad FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.rid <> a.rid AND b.s < a.e AND a.s < b.e) GROUP BY k")
def temporal_without_overlaps(spark, d):
    return T.overlapping(periods(spark, d).filter("s < e"), ["k"], "s", "e").groupBy("k").agg((F.count(F.lit(1)) > 0).alias("bad"))


@query(
    "temporal_foreign_key",
    f"""WITH p AS (SELECT DISTINCT k, s AS t FROM (SELECT k, unnest(range(s, e)) AS s FROM {P} WHERE n % 2 = 0)), ch AS (SELECT k, n, s, e FROM {P} WHERE n % 2 = 1 AND s < e)
    SELECT k, n, s, e FROM ch WHERE (SELECT count(*) FROM p WHERE p.k = ch.k AND p.t >= ch.s AND p.t < ch.e) < e - s""",
)
def temporal_foreign_key(spark, d):
    p = periods(spark, d)
    return T.uncovered(p.filter("n % 2 = 1 and s < e"), p.filter("n % 2 = 0 and s < e"), ["k"], "s", "e")
