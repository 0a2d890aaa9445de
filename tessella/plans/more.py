"""Joins by strategy, foreign tables, sources of one's own, distribution, tensors, dictionaries, the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import kinds as K
from tessella.functions import tensors as X
from tessella.operators import distribution as D
from tessella.plans.registry import cases, expect, query, statement, views
from tessella.session import scratch, table
from tessella.sources import custom
from tessella.sources.tables import ForeignServer, MaterializedView, StoredTable

c, f = F.col, F.lit

_J = "SELECT {} o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000"
for _name, _hint in {"join_merge": "/*+ MERGE(customer) */", "join_shuffle_hash": "/*+ SHUFFLE_HASH(customer) */"}.items():
    statement(_name, _J.format(_hint), _J.format(""))
statement("join_nested_loop", "SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_nationkey > b.n_nationkey + 20")
statement("join_semi_nested", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey * 5 > n_nationkey)")
statement("incremental_sort", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) AS n FROM (SELECT * FROM orders ORDER BY o_custkey, o_orderdate) t")
statement("agg_min_max", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")


@query("clustered_index_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def clustered_index_scan(spark, d):
    """A table clustered by a column: files hold ranges of it, so their statistics skip all but a few."""
    path = scratch(spark, "clustered")
    table(spark, d, "orders").select("o_orderkey", "o_custkey").repartitionByRange(16, "o_custkey").sortWithinPartitions("o_custkey").write.parquet(path)
    return spark.read.parquet(path).filter("o_custkey between 10 and 20")


@query("materialize_node", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT -1, count(*) FROM customer WHERE c_acctbal > 0")
def materialize_node(spark, d):
    from tessella.session import materialize

    once = materialize(table(spark, d, "customer").filter("c_acctbal > 0").select("c_nationkey"), "once")
    return once.groupBy("c_nationkey").agg(F.count(f(1)).alias("n")).unionByName(once.agg(f(-1).alias("c_nationkey"), F.count(f(1)).alias("n")))


@query("foreign_table", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 15 UNION ALL SELECT n_regionkey::BIGINT + 1000, count(*)::VARCHAR FROM nation GROUP BY n_regionkey")
def foreign_table(spark, d):
    """A database behind JDBC: written to, read with a filter pushed down, and asked a statement of its own."""
    import uuid

    server = ForeignServer(spark, f"jdbc:derby:memory:tessella{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    server.insert(table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("n_nationkey"), c("n_name").cast("varchar(40)").alias("n_name"), c("n_regionkey").cast("long").alias("n_regionkey")), "nation")
    some = server.table("nation", "n_nationkey", 0, 25, 3, where='"n_nationkey" > 15').select("n_nationkey", "n_name")
    asked = server.query('SELECT "n_regionkey" AS r, count(*) AS n FROM nation GROUP BY "n_regionkey"')
    return some.unionByName(asked.select((F.col(asked.columns[0]) + 1000).alias("n_nationkey"), F.col(asked.columns[1]).cast("string").alias("n_name")))


@query("custom_source", "SELECT generate_series::BIGINT AS id FROM generate_series(10, 1000, 7) WHERE generate_series > 100 AND generate_series <= 500")
def custom_source(spark, d):
    custom.register(spark)
    return spark.read.format("series").option("start", 10).option("stop", 1000).option("step", 7).load().filter("id > 100 and id <= 500")


@query("custom_stream_source", "SELECT generate_series::BIGINT AS id FROM generate_series(1, 250)")
def custom_stream_source(spark, d):
    custom.register(spark)
    s = spark.readStream.format("series").option("stop", 250).option("rows", 100).load()
    out, mark = scratch(spark, "series"), scratch(spark, "series-checkpoint")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(s.schema).parquet(out)


@query("distribute_table", "SELECT (SELECT count(*) FROM customer) AS rows, 4::BIGINT AS shards, true AS same_shard, true AS joined")
def distribute_table(spark, d):
    a, b = scratch(spark, "a"), scratch(spark, "b")
    D.distribute(table(spark, d, "customer").select(c("c_custkey").alias("k"), "c_nationkey"), a, ["k"], 4)
    D.distribute(table(spark, d, "orders").select(c("o_custkey").alias("k"), "o_orderkey"), b, ["k"], 4)
    x, y = spark.read.parquet(a), spark.read.parquet(b)
    met = x.join(y.select("k", c("shard").alias("s"), "o_orderkey"), "k")
    want = table(spark, d, "orders").join(D.reference(table(spark, d, "customer").select("c_custkey")), c("o_custkey") == c("c_custkey")).agg(F.count(f(1)).alias("w"))
    one = x.agg(F.count(f(1)).alias("rows"), F.count_distinct("shard").alias("shards"))
    return one.crossJoin(met.agg(F.bool_and(c("shard") == c("s")).alias("same_shard"), F.count(f(1)).alias("m"))).crossJoin(want).select("rows", "shards", "same_shard", (c("m") == c("w")).alias("joined"))


@query("run_on_all_shards", "SELECT count(*) AS total, 3::BIGINT AS shards FROM customer")
def run_on_all_shards(spark, d):
    got = D.on_all_shards(D.shard_of(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 3), lambda t: t.num_rows)
    return got.agg(F.sum(c("result").cast("long")).alias("total"), F.count(f(1)).alias("shards"))


@query("rebalance_shards", expect("shard, source, target", (3, "gone", "b"), (2, "a", "b")))
def rebalance_shards(spark, d):
    return spark.createDataFrame(D.rebalance({1: "a", 2: "a", 3: "gone"}, {1: 50, 2: 30, 3: 10}, ["a", "b"]), "shard int, source string, target string")


@query("vectorize_query", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def vectorize_query(spark, d):
    views(spark, d, "lineitem")
    assert "Scan" in D.vectorize_explain(spark, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
    assert D.vectorize_status(spark).count() == len(D.PRESET)
    return D.vectorize_query(spark, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")


@query("projection_refresh", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 99, 1")
def projection_refresh(spark, d):
    """A stored projection that an insert's trigger refreshes."""
    t = StoredTable(spark, scratch(spark, "base"), ["c_custkey"])
    t.write(table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    p = MaterializedView(spark, scratch(spark, "projection"), lambda: t.read().groupBy("c_nationkey").agg(F.count(f(1)).alias("n")))
    t.on("insert", lambda ch: p.refresh())
    t.insert(spark.sql("SELECT -5L AS c_custkey, 99 AS c_nationkey"))
    return p.read()


@cases("tensors", "SELECT array(1, 2, 3, 4, 5, 6) AS a, array(1, 0, 0, 1, 1, 1) AS b", expect("n, x, r, s, m, t, p, k", (2, 6.0, [3, 2], [2.0, 2.0, 3.0, 5.0, 6.0, 7.0], [1.0, 0.0, 0.0, 4.0, 5.0, 6.0], [1.0, 4.0, 2.0, 5.0, 3.0, 6.0], [4.0, 5.0, 10.0, 11.0], 42.0)))
def _():
    a, b = X.tensor(c("a"), [2, 3]), X.tensor(c("b"), [2, 3])
    return {"n": X.ndims(a), "x": X.at(a, 1, 2), "r": X.reshape(a, [3, 2])["dims"], "s": X.add(a, b)["data"], "m": X.multiply(a, b)["data"], "t": X.transpose(a)["data"], "p": X.matmul(a, X.reshape(b, [3, 2]))["data"], "k": X.total(X.scale(a, 2.0))}


@cases("fn_dictionaries", "SELECT 'Stories' AS w, '40865854' AS n", expect("i, r, sy, none, si, st, af", (["408658"], [], ["pg", "post", "elephant"], None, ["stories"], [], ["story"])))
def _():
    return {"i": K.dict_int(c("n")), "r": K.dict_int(c("n"), reject_long=True), "sy": K.dict_synonyms(f("PG"), {"pg": ["post", "elephant"]}), "none": K.dict_synonyms(f("x"), {"pg": ["y"]}), "si": K.dict_simple(c("w"), ["the"]), "st": K.dict_simple(f("The"), ["the"]), "af": K.dict_affixes(c("w"), ["story", "dog"], [("ies", "y"), ("s", "")])}


@query("fn_seg", expect("s, lo, hi, o, k", ("5.0", 5.0, 5.0, True, True), ("1.5..2.5", 1.5, 2.5, False, False), ("..7", None, 7.0, True, False), ("5 '+-' 0.5", 4.5, 5.5, True, True)))
def fn_seg(spark, d):
    t = spark.sql("SELECT * FROM VALUES ('5.0'), ('1.5..2.5'), ('..7'), ('5 ''+-'' 0.5') AS t(s)").select("s", K.seg(c("s")).alias("g"), K.seg(f("4..6")).alias("w"))
    return t.select("s", "g.lo", "g.hi", K.seg_overlaps(c("g"), c("w")).alias("o"), K.seg_contains(c("w"), c("g")).alias("k"))


@query("fn_citext", "SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY 1")
def fn_citext(spark, d):
    x = table(spark, d, "customer").select(F.when(c("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(c("c_mktsegment")).alias("s"))
    return x.groupBy(K.citext(c("s")).alias("s")).agg(F.count(f(1)).alias("n")).select(F.lower("s").cast("string").alias("s"), "n")


@query("fn_xmltable", expect("n, id, name, size", (1, "AU", "Australia", 5.5), (2, "CN", "China", None)))
def fn_xmltable(spark, d):
    one = spark.sql("""SELECT '<rows><row id="AU"><name>Australia</name><size>5.5</size></row><row id="CN"><name>China</name></row></rows>' AS s""")
    return one.select(F.inline(K.xmltable(c("s"), "/rows/row", {"n": ("ordinality", ""), "id": ("string", "@id"), "name": ("string", "name"), "size": ("double", "size")})))


@query("fn_int_aggregate", "SELECT n_regionkey, to_json(list(n_nationkey ORDER BY n_nationkey))::VARCHAR AS a FROM nation GROUP BY 1")
def fn_int_aggregate(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(K.int_array_aggregate(c("n_nationkey"), c("n_nationkey"))).alias("a"))


@query("fn_hashes", "SELECT p_partkey, true AS same, true AS rec, true AS arr, 16 AS n FROM part")
def fn_hashes(spark, d):
    p = table(spark, d, "part")
    name = c("p_name")
    return p.select("p_partkey", (K.hash_values(1, name) == K.hash_values(1, F.concat(name, f("")))).alias("same"), (K.hash_values(1, F.struct("p_name", "p_size")) == K.hash_values(1, F.struct("p_name", "p_size"))).alias("rec"), (K.hash_values(1, F.split(name, " ")) != K.hash_values(1, F.array(F.concat(name, f("x"))))).alias("arr"), F.length(K.random_bytes(16, 3, c("p_partkey"))).alias("n"))


@query("fn_catalog", expect("db, schema, version, kind, there, gone", ("spark_catalog", "default", True, "decimal(12,2)", True, False)))
def fn_catalog(spark, d):
    views(spark, d, "orders")
    return spark.sql("SELECT current_catalog() AS db, current_schema() AS schema, length(version()) > 0 AS version, typeof(CAST(1 AS decimal(12,2))) AS kind").withColumn("there", f(spark.catalog.tableExists("orders"))).withColumn("gone", f(spark.catalog.tableExists("no_such_table")))


@query("fn_relation_size", "SELECT 16 AS files, true AS sized")
def fn_relation_size(spark, d):
    """Partitions of a stored table: their files and bytes."""
    path = scratch(spark, "sized")
    table(spark, d, "orders").select("o_orderkey", (c("o_orderkey") % 16).alias("p")).repartition("p").write.partitionBy("p").parquet(path)
    t = spark.read.parquet(path).select("p", c("_metadata.file_path").alias("f"), c("_metadata.file_size").alias("s")).distinct()
    return t.agg(F.count_distinct("p").cast("int").alias("files"), F.bool_and(c("s") > 0).alias("sized"))


statement("fn_bit_operators", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, ~p_size AS n, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r FROM part")
