"""Operators of the engine against brute force: nulls, ties, outer sides, empty tables; streams with late rows; models."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import fulltext, jsonb, jsonpath
from tessella.operators import collections, graphs, joins, sketches, timeseries, vectors, windows
from tessella.plans import registry
from tessella.session import scratch
from tessella.sources import files, tables
from tessella.streaming import windows as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("width", [1.0, 7.5])
def test_range_join(spark, width):
    r = random.Random(3)
    pts = [(i, r.choice([None, float("nan"), r.uniform(-50, 50), r.randint(-50, 50) * 1.0])) for i in range(200)]
    ivs = [(i, *sorted((r.uniform(-60, 60), r.uniform(-60, 60)))) for i in range(60)] + [(90, 5.0, 5.0), (91, None, 3.0), (92, float("-inf"), 0.0), (93, 0.0, float("inf")), (94, 9.0, 2.0), (95, -1e300, 1e300)]
    got = joins.range_join(spark.createDataFrame(pts, "p long, x double"), spark.createDataFrame(ivs, "i long, lo double, hi double"), "x", "lo", "hi", width).select("p", "i")
    want = [(p, i) for p, x in pts for i, lo, hi in ivs if x is not None and lo is not None and lo <= x < hi]
    assert rows(got) == sorted(want, key=str)


def test_asof_join_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None), (4, "b", 1), (5, "a", 4)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", None, "n"), (None, 1, "m"), ("b", 2, "y")], "k string, t int, v string")
    assert rows(joins.asof_join(left, right, ["k"], "t", ["v"]).select("id", "v")) == sorted([(1, "x"), (2, None), (3, None), (4, None), (5, "x")], key=str)
    assert joins.asof_join(left, right.limit(0), ["k"], "t", ["v"]).count() == 5


def test_salted_join_holds_no_side_whole(spark):
    a, b = spark.range(100).selectExpr("id AS k", "id AS x"), spark.range(10).selectExpr("id AS k", "id AS y")
    plan = joins.salted_join(a, b, ["k"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_blocks_and_nulls(spark):
    r = random.Random(5)
    base = [(i, [float(r.randint(0, 3)), float(r.randint(0, 3))]) for i in range(60)] + [(60, None), (61, [1.0, None]), (62, [1e200, 0.0])]
    asked = [(i, [r.uniform(0, 3), float(r.randint(0, 3))]) for i in range(10_001)] + [(10_001, None)]
    e = spark.createDataFrame(base, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    got = {}
    for i, v, d, n in vectors.nearest(e, q, 62).collect():
        got.setdefault(i, {})[n] = (v, d)
    assert len(got) == 10_002 and all(len(x) == 62 for x in got.values())
    for i, y in asked[::500] + asked[-1:]:
        d = [(v, None if y is None or x is None or None in x else ((x[0] - y[0]) * (x[0] - y[0]) + (x[1] - y[1]) * (x[1] - y[1])) ** 0.5 if x[0] < 1e9 else float("inf")) for v, x in base]
        assert [got[i][n] for n in range(1, 63)] == sorted(d, key=lambda t: (t[1] is None, t[1] or 0, t[0]))[:62]


def test_inverted_lists_are_exact_without_probes(spark):
    r = random.Random(6)
    e = spark.createDataFrame([(i, [r.gauss(i % 3 * 2, 1) for _ in range(6)]) for i in range(900)], "vec_id long, embedding array<double>")
    q = e.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    lists = vectors.InvertedLists(e, lists=60)
    index, exact = lists.assign(e), vectors.nearest(e, q, 10)
    assert rows(lists.search(index, q, 10)) == rows(exact)
    assert 0.2 < vectors.recall(lists.search(index, q, 10, 3), exact) < 1


def test_range_operators_run_on_all_cores(spark, tmp_path):
    """One file of suppliers is many pairs: they must not come from one task."""
    spark.range(1000).selectExpr("id AS s_suppkey", "CAST(id % 2 AS int) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.queries()["fn_range_operators"](spark, str(tmp_path))
    dealt = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 8 and sum(r[1] for r in dealt) == 500_000 and max(r[1] for r in dealt) < 100_000


@pytest.mark.parametrize("name, column, sketch", [("approx_distinct_lineitem", "l_partkey", "approx_count_distinct"), ("sketch_hll", "user_id", "hll_sketch_agg")])
def test_no_sketch_per_distinct_value(spark, name, column, sketch):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    aggregates = [line.split("functions=") for line in plan.splitlines() if "Aggregate(" in line]
    assert any(column in keys for keys, _ in aggregates) and any(sketch in functions for _, functions in aggregates)
    assert not any(column in keys and sketch in functions for keys, functions in aggregates)


def test_salted_join(spark):
    a, b = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, x string"), spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    assert rows(joins.salted_join(a, b, ["k"], 3)) == rows(a.join(b, "k")) and rows(joins.salted_join(a, b, ["k"], 3, "left")) == rows(a.join(b, "k", "left"))
    assert rows(joins.salted_join(a, b, ["k"], 3, "left_anti")) == [(2, "r")]
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            joins.salted_join(a, b, ["k"], 3, how)


def test_excluded_frames(spark):
    r = random.Random(1)
    data = [(i, r.randrange(6), r.choice([None, r.randrange(9)])) for i in range(40)]
    df = spark.createDataFrame(data, "i int, o int, v long")
    w, peers = Window.orderBy("o").rangeBetween(-1, 1), Window.partitionBy("o")
    for kind in ("group", "ties"):
        got = {x["i"]: (x["s"], x["n"]) for x in df.select("i", windows.excluded(kind, "sum", F.col("v"), w, peers).alias("s"), windows.excluded(kind, "count", F.col("v"), w, peers).alias("n")).collect()}
        for i, o, v in data:
            frame = [x for j, p, x in data if abs(p - o) <= 1 and (p != o or (kind == "ties" and j == i)) and x is not None]
            assert got[i] == (sum(frame) if frame else None, len(frame))


def test_continuous_aggregate(spark):
    rows_ = [(1, dt.datetime(2024, 1, d, h)) for d in range(1, 6) for h in (1, 2)]
    e = spark.createDataFrame(rows_, "v int, ts timestamp_ntz")
    c = timeseries.ContinuousAggregate(scratch(spark, "agg"), "ts", 86400, [], {"n": F.count(F.lit(1))})
    c.create(e)
    # rows of the last two days go, one is new; earlier days count as they did, whatever the table holds now
    later = spark.createDataFrame([(1, dt.datetime(2024, 1, 4, 9)), (1, dt.datetime(2024, 1, 1, 9))], "v int, ts timestamp_ntz")
    c.refresh(later, F.lit(dt.datetime(2024, 1, 4)))
    assert {x["bucket"].day: x["n"] for x in c.read(spark).collect()} == {1: 2, 2: 2, 3: 2, 4: 1}
    s = c.status(spark).first()
    assert (s["versions"], s["buckets"], s["last_bucket"].day) == (2, 4, 4)
    c.drop(spark)
    assert c.versions(spark) == []


def test_late_rows_are_left_out(spark):
    path = scratch(spark, "late")
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    for i, part in enumerate([[1, 2], [75], [76], [3, 80], [200]]):
        spark.createDataFrame([(at(m),) for m in part], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    import os
    import time

    for i in range(5):
        for name in os.listdir(f"{path}/{i}"):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{i}/{name}", (time.time() - 100 + i * 10,) * 2)
    s = streams.tumbling(streams.file_stream(spark, f"{path}/*", "ts timestamp", 1), "ts", "1 hour", "10 minutes", [], {"n": F.count(F.lit(1))})
    got = spark.read.schema(s.schema).parquet(streams.run_to_end(s, "append", "late"))
    assert sorted(x["n"] for x in got.collect()) == [2, 3]  # 1 and 2; 75, 76 and 80; 3 came too late, 200 is still open


def test_recursive_union_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None), (4, 5)], "src int, dst int")
    out = graphs.recursive_union(spark.sql("SELECT 1 AS k"), lambda r: r.join(e, r.k == e.src).select(F.col("dst").alias("k")))
    assert rows(out) == sorted([(1,), (2,), (3,), (None,)], key=str)
    assert rows(graphs.reach(e, 1)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graphs.reach(e.limit(0), 1)) == [(1, 0)]
    with pytest.raises(ValueError):
        graphs.shortest_paths(e.withColumn("w", F.lit(-1.0)), 1, weight="w")
    with pytest.raises(RuntimeError):
        graphs.recursive_search(spark.sql("SELECT 1 AS k"), e, "k", "src", "dst")


def test_merge_rejects_two_sources(spark):
    t = tables.StoredTable(spark, scratch(spark, "t"), ["k"])
    t.write(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), [(None, "delete", None)], [])
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(2, "z")], "k int, v string"))
    t.merge(spark.createDataFrame([], "k int, v string"), [(None, "delete", None)], [(None, None)])
    assert rows(t.read()) == [(1, "a"), (2, None)]


def test_copy_rejects(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([("1\tx",), ("y\tz",)], "value string").write.text(path)
    with pytest.raises(Exception, match="fit"):
        files.copy_from(spark, path, "k int, s string", files.AllowList(path)).collect()
    with pytest.raises(ValueError):
        files.copy_from(spark, path, "k int, s string", files.AllowList(path), on_error="ignore", reject_limit=0)
    with pytest.raises(files.NotAllowed):
        files.read_csv(spark, "/etc", files.AllowList(path))


def test_top_k_bounds(spark):
    r = random.Random(9)
    data = [min(int(r.paretovariate(1.1)), 5000) for _ in range(20_000)]
    truth = {x: data.count(x) for x in set(data)}
    got = sketches.top_k(spark.createDataFrame([(x,) for x in data], "x int").repartition(6), "x", 5, 50).collect()
    for x in got:
        assert x["count"] - x["error"] <= truth[x["x"]] <= x["count"] or truth[x["x"]] - x["count"] <= 6 * len(data) / 50
    assert got[0]["x"] == max(truth, key=truth.get)


def test_vector_dimensions_must_agree(spark):
    from tessella.functions import vectors as V

    with pytest.raises(Exception, match="dimensions"):
        spark.sql("SELECT array(1D, 2D) AS a, array(1D) AS b").select(V.l2_distance(F.col("a"), F.col("b"))).collect()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.top_k(empty, [1.0], 3).count() == 0 and vectors.InvertedLists(empty).centroids.shape == (0, 0)


def test_json_errors():
    with pytest.raises(jsonpath.PathError):
        jsonpath.query({}, "strict $.a")
    with pytest.raises(jsonpath.PathError):
        jsonpath.query({}, "$[")
    assert jsonpath.query({"a": [1]}, "$.a[5]") == [] and jsonpath.match({"a": 1}, "$.a") is None
    with pytest.raises(ValueError):
        jsonb.load("{a}")
    with pytest.raises(fulltext.QueryError):
        fulltext.parse_query("a & & b")
    assert fulltext.web_query('""" )( dummy \\ query <->') is not None


def _field(no, kind, payload):
    key = bytes([no << 3 | kind])
    if kind == 0:
        return key + bytes([payload])
    return key + bytes([len(payload)]) + payload


def scaling_model():
    """A model y = x + x, written out in the interchange format by hand."""
    s = lambda no, t: _field(no, 2, t.encode())
    shape = _field(2, 2, _field(1, 2, s(2, "n")) + _field(1, 2, _field(1, 0, 3)))
    value = lambda n: s(1, n) + _field(2, 2, _field(1, 2, _field(1, 0, 1) + shape))
    node = s(1, "x") + s(1, "x") + s(2, "y") + s(4, "Add")
    graph = _field(1, 2, node) + s(2, "g") + _field(11, 2, value("x")) + _field(12, 2, value("y"))
    return _field(1, 0, 8) + _field(7, 2, graph) + _field(8, 2, s(1, "") + _field(2, 0, 13))


def test_inference(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "id int, v array<float>")
    got = {x["id"]: x["output"] for x in collections.infer(df, scaling_model(), "v", 4).collect()}
    assert got == {i: [2.0 * i, 2.0, 4.0] for i in range(10)}
