"""Sketches, held against exact results: each query tells whether the stated bound is kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import sketches as S
from tessella.plans.registry import query, statement
from tessella.session import table

c = F.col


@query("sketch_count_min", "SELECT true AS never_below, true AS near, (SELECT count(DISTINCT user_id) FROM events) AS n")
def sketch_count_min(spark, d):
    e = table(spark, d, "events")
    cm = S.CountMin(2000, 5)
    a, b = cm.create(e.filter("event_id % 2 = 0"), c("user_id")), cm.create(e.filter("event_id % 2 = 1"), c("user_id"))
    truth = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    got = cm.estimate(S.CountMin.merge(a, b), truth, "user_id").join(truth, "user_id")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    off = got.crossJoin(F.broadcast(total)).agg(F.bool_and(c("estimate") >= c("n")).alias("never_below"), F.avg(F.when(c("estimate") - c("n") > c("total") * 2.7183 / 2000, 1.0).otherwise(0.0)).alias("over"), F.count(F.lit(1)).alias("n"))
    return off.select("never_below", (c("over") <= 0.02).alias("near"), "n")


@query("sketch_top_k", "SELECT event_type, count(*) AS count, 0::BIGINT AS error FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def sketch_top_k(spark, d):
    return S.top_k(table(spark, d, "events"), "event_type", 3)


@query("sketch_bloom", "SELECT (SELECT count(*) FROM customer) AS added, true AS all_found, true AS few_false, 96::BIGINT AS bits, 7::BIGINT AS hashes")
def sketch_bloom(spark, d):
    cu = table(spark, d, "customer").select("c_custkey")
    n = cu.count()
    bloom, small = S.Bloom(max(n, 1), 0.01), S.Bloom(10, 0.01)
    sk = S.Bloom.merge(bloom.create(cu.filter("c_custkey % 2 = 0"), c("c_custkey")), bloom.create(cu.filter("c_custkey % 2 = 1"), c("c_custkey")))
    others = cu.select((-c("c_custkey") - 1).alias("c_custkey"))
    inside = bloom.contains(sk, cu, "c_custkey").agg(F.count(F.lit(1)).alias("added"), F.bool_and("found").alias("all_found"))
    outside = bloom.contains(sk, others, "c_custkey").agg((F.avg(c("found").cast("int")) <= 0.03).alias("few_false"))
    return inside.crossJoin(outside).select("added", "all_found", "few_false", F.lit(small.m).cast("long").alias("bits"), F.lit(small.k).cast("long").alias("hashes"))


@query("sketch_tdigest", "SELECT o_orderstatus, true AS q50, true AS q99, true AS cdf FROM orders GROUP BY 1")
def sketch_tdigest(spark, d):
    o = table(spark, d, "orders")
    t = S.TDigest(100)
    whole = t.merge(t.create(o.filter("o_orderkey % 2 = 0"), c("o_totalprice"), "o_orderstatus"), t.create(o.filter("o_orderkey % 2 = 1"), c("o_totalprice"), "o_orderstatus"))
    exact = o.groupBy("o_orderstatus").agg(F.expr("percentile(o_totalprice, 0.49)").alias("a"), F.expr("percentile(o_totalprice, 0.51)").alias("b"), F.expr("percentile(o_totalprice, 0.98)").alias("x"), F.max("o_totalprice").alias("y"), F.avg((c("o_totalprice") <= 150000).cast("int")).alias("p"))
    got = whole.select("o_orderstatus", S.TDigest.quantile(c("digest"), 0.5).alias("q50"), S.TDigest.quantile(c("digest"), 0.99).alias("q99"), S.TDigest.cdf(c("digest"), 150000.0).alias("cdf"))
    return got.join(exact, "o_orderstatus").select("o_orderstatus", c("q50").between(c("a"), c("b")).alias("q50"), c("q99").between(c("x"), c("y")).alias("q99"), (F.abs(c("cdf") - c("p")) < 0.01).alias("cdf"))


# the JVM's own sketches, each within its bound of the exact value
# the sketch and the exact count apart: side by side, every distinct value would carry a sketch of its own through the exchange
statement("sketch_hll", "SELECT a.event_type, abs(e - x) <= 0.03 * x + 1 AS close FROM (SELECT event_type, hll_sketch_estimate(hll_sketch_agg(user_id, 14)) AS e FROM events GROUP BY event_type) a JOIN (SELECT event_type, count(DISTINCT user_id) AS x FROM events GROUP BY event_type) b ON a.event_type <=> b.event_type", "SELECT event_type, true AS close FROM events GROUP BY 1")
statement("sketch_hll_union", "SELECT abs(hll_sketch_estimate(hll_union_agg(s)) - (SELECT count(DISTINCT user_id) FROM events)) <= 0.03 * (SELECT count(DISTINCT user_id) FROM events) + 1 AS close FROM (SELECT event_type, hll_sketch_agg(user_id, 14) AS s FROM events GROUP BY event_type)", "SELECT true AS close")
