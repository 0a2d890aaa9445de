"""Files, samples, stored tables and what changes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import jsonb as J
from tessella.plans.registry import expect, query
from tessella.session import scratch, table
from tessella.sources import files, sampling, tables

c = F.col


@query("source_read_csv", "SELECT p_partkey::VARCHAR AS k, p_name AS name, p_retailprice::VARCHAR AS price FROM part")
def source_read_csv(spark, d):
    path = scratch(spark, "csv")
    files.copy_to(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, "csv")
    rows = files.read_csv(spark, path, files.AllowList(path), has_header=False)
    return rows.select(J.arrow_text(c("row"), "column1").alias("k"), J.arrow_text(c("row"), "column2").alias("name"), J.arrow_text(c("row"), "column3").alias("price"))


@query("source_read_json", "SELECT event_id, props FROM events")
def source_read_json(spark, d):
    path = scratch(spark, "json")
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(path)
    rows = files.read_json(spark, path, files.AllowList(path))
    return rows.select(F.get_json_object("row", "$.event_id").cast("long").alias("event_id"), F.get_json_object("row", "$.props").alias("props"))


@query("source_allow_list", expect("path, ok", ("/data/in/a.csv", True), ("/data/in", True), ("/data/inside/a.csv", False), ("/data/in/../secret", False), ("file:///data/in/x/*.csv", True), ("s3://bucket/a", False), ("/etc/passwd", False)))
def source_allow_list(spark, d):
    allowed = files.AllowList("/data/in")

    def ok(p):
        try:
            return bool(allowed.check(p))
        except files.NotAllowed:
            return False

    return spark.createDataFrame([(p, ok(p)) for p in ("/data/in/a.csv", "/data/in", "/data/inside/a.csv", "/data/in/../secret", "file:///data/in/x/*.csv", "s3://bucket/a", "/etc/passwd")], "path string, ok boolean")


@query("copy_text_round_trip", "SELECT doc_id, text, source FROM documents")
def copy_text_round_trip(spark, d):
    path = scratch(spark, "copy")
    files.copy_to(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    return files.copy_from(spark, path, "doc_id long, text string, source string", files.AllowList(path))


@query("copy_text_escapes", expect("k, s, n", (1, "a\tb\\c\nd", None), (2, "\\N", 5), (3, "", None), (4, None, 7), (5, "x\\ty", 8)))
def copy_text_escapes(spark, d):
    path = scratch(spark, "copy")
    rows = spark.createDataFrame([(1, "a\tb\\c\nd", None), (2, "\\N", 5), (3, "", None), (4, None, 7), (5, "x\\ty", 8)], "k int, s string, n int")
    files.copy_to(rows, path, header=True)
    return files.copy_from(spark, path, "k int, s string, n int", files.AllowList(path), header=True)


@query("copy_csv_errors", expect("k, s, n", (1, 'say "hi", now', 10), (2, "", None), (3, None, 42)))
def copy_csv_errors(spark, d):
    """Quotes, nulls, a default, and lines that don't fit passed by."""
    path = scratch(spark, "copy")
    spark.createDataFrame([('1,"say ""hi"", now",10',), ('2,"",',), ("3,,*",), ("x,bad,1",), ("4,few",)], "value string").write.text(path)
    return files.copy_from(spark, path, "k int, s string, n int", files.AllowList(path), "csv", on_error="ignore", reject_limit=2, default="*", defaults={"n": F.lit(42)})


@query("copy_custom_format", expect("k, s", (1, "a"), (2, "b")))
def copy_custom_format(spark, d):
    class Pipes(files.CopyFormat):
        def line(self, fields):
            return F.concat_ws("|", *[x.cast("string") for x in fields])

        def fields(self, line):
            return F.split(line, "[|]")

    files.register_format("pipes", Pipes)
    path = scratch(spark, "copy")
    files.copy_to(spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"), path, "pipes")
    return files.copy_from(spark, path, "k int, s string", files.AllowList(path), "pipes")


@query("sample_bernoulli", "SELECT true AS near, true AS same, true AS none, true AS everything, true AS differs")
def sample_bernoulli(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = li.agg(F.count(F.lit(1)).alias("n"))
    s = sampling.bernoulli(li, 20, 7, "l_orderkey", "l_linenumber")
    counts = s.agg(F.count(F.lit(1)).alias("s")).crossJoin(n).select((F.abs(c("s") - 0.2 * c("n")) < 5 * F.sqrt(0.16 * c("n"))).alias("near"))
    again = s.repartition(7).exceptAll(sampling.bernoulli(li.repartition(3), 20, 7, "l_orderkey", "l_linenumber")).agg((F.count(F.lit(1)) == 0).alias("same"))
    other = s.exceptAll(sampling.bernoulli(li, 20, 8, "l_orderkey", "l_linenumber")).agg((F.count(F.lit(1)) > 0).alias("differs"))
    none = sampling.bernoulli(li, 0, 7).agg((F.count(F.lit(1)) == 0).alias("none"))
    every = li.exceptAll(sampling.bernoulli(li, 100, 7)).agg((F.count(F.lit(1)) == 0).alias("everything"))
    return counts.crossJoin(again).crossJoin(none).crossJoin(every).crossJoin(other)


@query("sample_system", "SELECT true AS whole_blocks")
def sample_system(spark, d):
    """Blocks come whole or not at all."""
    path = scratch(spark, "blocks")
    table(spark, d, "orders").select("o_orderkey").repartition(16).write.parquet(path)
    got = sampling.system(spark.read.parquet(path), 50, 3).select("o_orderkey", F.input_file_name().alias("f"))
    whole = spark.read.parquet(path).select("o_orderkey", F.input_file_name().alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy("f").agg(F.count(F.lit(1)).alias("m")).join(whole, "f").agg(F.coalesce(F.bool_and(c("m") == c("n")), F.lit(True)).alias("whole_blocks"))


@query("sample_system_rows", "SELECT least(100, count(*)) AS n, true AS within FROM orders")
def sample_system_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    s = sampling.system_rows(o, 100, 5, "o_orderkey")
    return s.join(o.withColumn("there", F.lit(True)), "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("within"))


@query("sample_system_time", "SELECT true AS within")
def sample_system_time(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return sampling.system_time(o, 50.0, 5).join(o.withColumn("there", F.lit(True)), "o_orderkey", "left").agg(F.coalesce(F.bool_and("there"), F.lit(True)).alias("within"))


def stored(spark, d, name="customer", key=("c_custkey",), columns=("c_custkey", "c_name", "c_acctbal", "c_nationkey")):
    t = tables.StoredTable(spark, scratch(spark, name), list(key))
    t.write(table(spark, d, name).select(*columns))
    return t


@query("dml_ctas", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def dml_ctas(spark, d):
    t = tables.StoredTable(spark, scratch(spark, "ctas"), ["c_custkey"])
    t.write(table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name"))
    return t.read()


@query("dml_insert_update_delete", "SELECT c_custkey, c_name || CASE WHEN c_nationkey = 3 THEN '!' ELSE '' END AS c_name, c_acctbal * CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS c_acctbal, c_nationkey FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT -1, 'new', 0, 7")
def dml_insert_update_delete(spark, d):
    t = stored(spark, d)
    t.insert(spark.sql("SELECT -1L AS c_custkey, 'new' AS c_name, 0D AS c_acctbal, 7 AS c_nationkey"))
    t.update(c("c_nationkey") == 3, {"c_name": F.concat("c_name", F.lit("!")), "c_acctbal": c("c_acctbal") * 2})
    t.delete(c("c_nationkey") == 5)
    t.vacuum()
    return t.read()


@query("dml_returning", "SELECT c_custkey, c_acctbal AS before, c_acctbal + 1 AS after FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer WHERE c_nationkey = 5")
def dml_returning(spark, d):
    t = stored(spark, d)
    up = t.update(c("c_nationkey") == 3, {"c_acctbal": c("c_acctbal") + 1}).select("new.c_custkey", c("old.c_acctbal").alias("before"), c("new.c_acctbal").alias("after"))
    return up.unionByName(t.delete(c("c_nationkey") == 5).select("c_custkey", c("c_acctbal").alias("before"), F.lit(None).cast("double").alias("after")))


_M = "SELECT c_custkey + 40 AS c_custkey, 'm' AS c_name, (c_custkey % 7)::DOUBLE AS c_acctbal, 1 AS c_nationkey FROM customer"


def _source(spark, d):
    return table(spark, d, "customer").select((c("c_custkey") + 40).alias("c_custkey"), F.lit("m").alias("c_name"), (c("c_custkey") % 7).cast("double").alias("c_acctbal"), F.lit(1).alias("c_nationkey"))


@query(
    "dml_merge",
    f"""WITH s AS ({_M}) SELECT t.c_custkey, CASE WHEN s.c_custkey IS NULL THEN 'lonely' ELSE t.c_name END AS c_name, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE t.c_acctbal + s.c_acctbal END AS c_acctbal, t.c_nationkey
    FROM customer t LEFT JOIN s USING (c_custkey) WHERE s.c_custkey IS NULL OR s.c_acctbal <> 3 UNION ALL SELECT s.* FROM s WHERE s.c_acctbal > 1 AND NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_custkey = s.c_custkey)""",
)
def dml_merge(spark, d):
    t = stored(spark, d)
    t.merge(_source(spark, d), [(c("s.c_acctbal") == 3, "delete", None), (None, "update", {"c_acctbal": c("t.c_acctbal") + c("s.c_acctbal")})], [(c("s.c_acctbal") > 1, None)], [(None, "update", {"c_name": F.lit("lonely")})])
    return t.read()


@query("dml_merge_returning", f"WITH s AS ({_M}) SELECT CASE WHEN t.c_custkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action, count(*) AS n FROM s LEFT JOIN customer t USING (c_custkey) GROUP BY 1")
def dml_merge_returning(spark, d):
    t = stored(spark, d)
    return t.merge(_source(spark, d), [(None, "update", {"c_acctbal": c("s.c_acctbal")})], [(None, None)]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("dml_upsert", f"WITH s AS ({_M}) SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE coalesce(t.c_acctbal, 0) + s.c_acctbal END AS c_acctbal, coalesce(t.c_nationkey, s.c_nationkey) AS c_nationkey FROM customer t FULL JOIN s USING (c_custkey)")
def dml_upsert(spark, d):
    t = stored(spark, d)
    t.upsert(_source(spark, d), {"c_name": c("excluded.c_name"), "c_acctbal": c("t.c_acctbal") + c("excluded.c_acctbal")})
    return t.read()


@query("dml_upsert_nothing", f"WITH s AS ({_M}) SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_upsert_nothing(spark, d):
    t = stored(spark, d)
    t.upsert(_source(spark, d))
    return t.read()


@query("dml_triggers", "SELECT 'update' AS event, count(*) AS n, round(sum(c_acctbal), 2) AS old_sum, round(sum(c_acctbal + 1), 2) AS new_sum FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'delete', count(*), round(sum(c_acctbal), 2), NULL FROM customer WHERE c_nationkey = 5")
def dml_triggers(spark, d):
    """Statement triggers that log what their transition tables hold."""
    t, log = stored(spark, d), []

    def note(ch):
        old = ch.old.agg(F.lit(ch.event).alias("event"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("old_sum"))
        new = ch.new.agg(F.round(F.sum("c_acctbal"), 2).alias("new_sum")) if ch.new is not None else spark.sql("SELECT CAST(NULL AS double) AS new_sum")
        log.append(old.crossJoin(new))

    t.on("update", note, "before")
    t.on("delete", note, "before")
    t.update(c("c_nationkey") == 3, {"c_acctbal": c("c_acctbal") + 1})
    t.delete(c("c_nationkey") == 5)
    return log[0].unionByName(log[1])


@query("materialized_view", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def materialized_view(spark, d):
    t = stored(spark, d)
    t.delete(c("c_nationkey") > 10)
    view = tables.MaterializedView(spark, scratch(spark, "view"), lambda: t.read().groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))
    t.write(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"))
    view.refresh()
    return view.read()


@query("row_security", "SELECT 'sales' AS role, count(*) AS n FROM customer WHERE (c_nationkey = 1 OR c_acctbal > 9000) AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'other', count(*) FROM customer WHERE c_acctbal > 9000 AND c_mktsegment <> 'BUILDING'")
def row_security(spark, d):
    p = tables.Policies()
    p.create(lambda: c("c_nationkey") == 1, "sales")
    p.create(lambda: c("c_acctbal") > 9000)
    p.create(lambda: c("c_mktsegment") != "BUILDING", permissive=False)
    cu = table(spark, d, "customer")
    one = lambda r: p.apply(cu, r).agg(F.lit(r).alias("role"), F.count(F.lit(1)).alias("n"))
    return one("sales").unionByName(one("other"))


@query("cursor_fetch", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 3")
def cursor_fetch(spark, d):
    cur = tables.Cursor(table(spark, d, "customer").select("c_custkey").orderBy("c_custkey"))
    cur.move(3)
    rows = cur.fetch(5)
    cur.close()
    return spark.createDataFrame(rows, "c_custkey long")


@query("sink_receivers", "SELECT r_regionkey, r_name FROM region")
def sink_receivers(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    tables.receiver(r, "none")
    assert len(list(tables.receiver(r, "remote"))) == r.count()
    return tables.receiver(r, "tuplestore", scratch(spark, "tuples"))


@query("cdc_arrow", "SELECT sum(1)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys, true AS bounded FROM orders")
def cdc_arrow(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    batches = tables.changes_to_arrow(o, 500)

    def back(parts):
        import pyarrow as pa

        for b in parts:
            for raw in b.column(2).to_pylist():
                t = pa.ipc.open_stream(raw).read_all()
                yield pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int64()), pa.array([sum(t.column(0).to_pylist())], pa.int64())], names=["n", "s"])

    got = batches.mapInArrow(back, "n long, s long")
    return got.agg(F.sum("n").alias("rows"), F.sum("s").alias("keys"), F.bool_and(c("n") <= 500).alias("bounded"))


@query("copy_from_dml", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 5")
def copy_from_dml(spark, d):
    """COPY of what a DELETE returns."""
    t, path = stored(spark, d), scratch(spark, "copy")
    files.copy_to(t.delete(c("c_nationkey") == 5).select("c_custkey", "c_acctbal"), path, "csv")
    return files.copy_from(spark, path, "c_custkey long, c_acctbal double", files.AllowList(path), "csv")
