"""Vectors: distances, nearest neighbours, inverted lists, products."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import vectors as O
from tessella.plans.registry import cases, expect, query
from tessella.session import table

c = F.col
Q = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
D = {"l2": "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]) ** 2)))", "l1": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1]::DOUBLE - z[2])))", "inner": "-list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]))"}
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x)))"
D["cosine"] = f"(1 + {D['inner']} / ({NORM} * {NORM.replace('{a}', '{b}')}))"


@cases("vec_distances", "SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id, " + ", ".join(f"round({D[k].format(a='a.embedding', b='b.embedding')}, 5) AS {k}" for k in ("l2", "l1", "inner", "cosine")) + " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _():
    return {"vec_id": c("vec_id"), **{k: F.round(V.DISTANCES[k](c("x"), c("y")), 5) for k in ("l2", "l1", "inner", "cosine")}}


@query("vec_knn", f"SELECT query_id, vec_id, round(d, 5) AS distance, rank::INT AS rank FROM (SELECT query_id, vec_id, {D['l2'].format(a='embedding', b='q')} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {D['l2'].format(a='embedding', b='q')}, vec_id) AS rank FROM embeddings, {Q}) WHERE rank <= 10")
def vec_knn(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("query_vector"))
    return O.nearest(e, queries, 10).withColumn("distance", F.round("distance", 5))


@query("vec_top_k", f"SELECT vec_id, abs(round({D['cosine'].format(a='embedding', b='q')}, 5)) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) ORDER BY {D['cosine'].format(a='embedding', b='q')}, vec_id LIMIT 20")
def vec_top_k(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 3").select("embedding").first()
    return O.top_k(e, one[0], 20, "cosine").select("vec_id", F.abs(F.round("distance", 5)).alias("distance"))


@query("vec_inverted_lists", "SELECT true AS good, (SELECT count(*) FROM embeddings) AS n")
def vec_inverted_lists(spark, d):
    """Recall at 10 of at least 0.9 against brute force, of every list that may hold a neighbour; every vector is filed once."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("query_vector"))
    lists = O.InvertedLists(e, lists=20)
    index = lists.assign(e)
    found, exact = lists.search(index, queries, 10), O.nearest(e, queries, 10)
    hit = found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("h"))
    return hit.crossJoin(exact.agg(F.count(F.lit(1)).alias("x"))).crossJoin(index.agg(F.count(F.lit(1)).alias("n"))).select((c("h") >= 0.9 * c("x")).alias("good"), "n")


@cases("vec_arithmetic", "SELECT array(1D, 2D, 2D) AS a, array(2D, 0D, -1D) AS b", expect("ad, su, mu, n, nr, sv, bq, h, j, dm, sq", ([3.0, 2.0, 1.0], [-1.0, 2.0, 3.0], [2.0, 0.0, -2.0], 3.0, 1.0, [2.0, 2.0], "100", 2, 0.666667, 3, 14.0)))
def _():
    a, b = c("a"), c("b")
    return {"ad": V.add(a, b), "su": V.subtract(a, b), "mu": V.multiply(a, b), "n": V.norm(a), "nr": V.norm(V.normalize(a)), "sv": V.subvector(a, 2, 2), "bq": V.binary_quantize(b), "h": V.hamming_distance(F.lit("1100"), F.lit("1010")), "j": F.round(V.jaccard_distance(F.lit("1100"), F.lit("1010")), 6), "dm": V.dims(a), "sq": V.l2_squared(a, b)}


@query("vec_aggregates", "SELECT label, round(sum(embedding[1]::DOUBLE), 4) AS s1, round(avg(embedding[3]::DOUBLE), 5) AS a3 FROM embeddings GROUP BY label")
def vec_aggregates(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(V.vector_sum(c("embedding"), 3).alias("s"), V.vector_avg(c("embedding"), 3).alias("a"))
    return e.select("label", F.round(F.get("s", F.lit(0)), 4).alias("s1"), F.round(F.get("a", F.lit(2)), 5).alias("a3"))


@query("vec_matmul", "SELECT a.n_nationkey AS i, b.r_regionkey AS j, sum(((a.n_nationkey + k) % 7) * ((k * b.r_regionkey) % 5))::DOUBLE AS v FROM nation a, range(6) t(k), region b GROUP BY ALL")
def vec_matmul(spark, d):
    n, r, k = table(spark, d, "nation"), table(spark, d, "region"), spark.range(6)
    a = n.crossJoin(F.broadcast(k)).select(c("n_nationkey").alias("i"), c("id").alias("j"), ((c("n_nationkey") + c("id")) % 7).cast("double").alias("v"))
    b = k.crossJoin(F.broadcast(r)).select(c("id").alias("i"), c("r_regionkey").alias("j"), ((c("id") * c("r_regionkey")) % 5).cast("double").alias("v"))
    return O.matmul(a, b)
