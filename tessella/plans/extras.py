"""Streams, queues, collections, schemas, rate limits, cron, charts, models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import documents as D
from tessella.functions import jsonb as J
from tessella.operators import collections as C
from tessella.plans.registry import cases, expect, query
from tessella.session import scratch, table
from tessella.sources.tables import StoredTable
from tessella.streaming import queues as Q
from tessella.streaming import windows as W

c, f = F.col, F.lit
NOW = dt.datetime(2024, 1, 1, 12, 0)


def event_stream(spark, d, files=4):
    path = scratch(spark, "events")
    e = table(spark, d, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(files, "ts").write.parquet(path)
    return W.file_stream(spark, path, e.schema, 1)


def done(spark, path, schema):
    out = spark.read.schema(schema).parquet(path)
    return out.withColumn("start", c("start").cast("timestamp_ntz")) if "start" in out.columns else out


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    s = W.tumbling(event_stream(spark, d), "ts", "1 hour", "30 days", ["event_type"], {"n": F.count(f(1)), "s": F.round(F.sum("value"), 4)}).drop("end")
    return done(spark, W.run_to_end(s, "complete", "tumbling"), s.schema)


@query("stream_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS s FROM events) GROUP BY s")
def stream_sliding(spark, d):
    s = W.sliding(event_stream(spark, d), "ts", "1 hour", "30 minutes", "30 days", [], {"n": F.count(f(1))}).drop("end")
    return done(spark, W.run_to_end(s, "complete", "sliding"), s.schema)


@query(
    "stream_session",
    """WITH x AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark, d):
    s = W.session(event_stream(spark, d), "ts", "2 hours", "30 days", ["user_id"], {"n": F.count(f(1))}).drop("end")
    return done(spark, W.run_to_end(s, "complete", "session"), s.schema)


@query("stream_deduplicate", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def stream_deduplicate(spark, d):
    s = W.deduplicate(event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    return done(spark, W.run_to_end(s, "append", "dedupe"), s.schema).groupBy("user_id", "event_type").agg(F.count(f(1)).alias("n"))


@query("stream_join", "SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1 hour' WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_join(spark, d):
    clicks = event_stream(spark, d).filter("event_type = 'click'").select(c("event_id").alias("click_id"), "user_id", c("ts").alias("at"))
    buys = event_stream(spark, d).filter("event_type = 'purchase'").select(c("event_id").alias("purchase_id"), "user_id", c("ts").alias("bought"))
    s = W.join_streams(clicks, buys, "user_id", "at", "bought", "1 hour", "3650 days").select("click_id", "purchase_id")
    return done(spark, W.run_to_end(s, "append", "join"), s.schema)


@query("stream_state", "SELECT event_type AS key, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state(spark, d):
    s = W.running_totals(event_stream(spark, d), "event_type", "value")
    got = spark.read.parquet(W.run_to_end(s, "update", "state"))
    return got.groupBy("key").agg(F.max_by(F.struct("n", "total"), "n").alias("x")).select("key", "x.n", F.round("x.total", 2).alias("total"))


@query("stream_notify", "SELECT DISTINCT event_type AS payload FROM events")
def stream_notify(spark, d):
    ch, heard = Q.Channels(), set()
    ch.listen("events", heard.add)
    W.run_to_end(event_stream(spark, d).select(c("event_type").alias("payload")), "append", "notify", ch.sink("events"))
    return spark.createDataFrame([(x,) for x in sorted(heard)], "payload string")


@query("queue_visibility", expect("step, body, deliveries", (1, "a", 1), (1, "b", 1), (2, "c", 1), (3, "b", 2), (4, "b", 3), (4, "c", 2), (5, "ready=0 in_flight=2 dead=0", 0)))
def queue_visibility(spark, d):
    """Received messages are hidden; b is given back, a acknowledged, c comes back when its time is up."""
    q = Q.Queue(spark, scratch(spark, "queue"), 30)
    q.send(spark.sql("SELECT * FROM VALUES ('a'), ('b'), ('c') AS t(body)"), NOW)
    out, sec = [], lambda n: NOW + dt.timedelta(seconds=n)
    take = lambda step, n, at: out.extend((step, r["body"], r["delivery_count"]) for r in q.receive(n, at).collect())
    take(1, 2, sec(0))
    take(2, 5, sec(1))
    q.ack([1])
    q.nack([2], sec(2))
    take(3, 5, sec(3))
    take(4, 5, sec(40))
    s = q.stats(sec(41)).first()
    out.append((5, f"ready={s[0]} in_flight={s[1]} dead={s[2]}", 0))
    return spark.createDataFrame(out, "step int, body string, deliveries int")


@query("topic_groups", expect("who, pos, body", ("g1", 1, "a"), ("g1", 2, "b"), ("g1 again", 1, "a"), ("g1 after", 3, "c"), ("g2", 1, "a")))
def topic_groups(spark, d):
    t = Q.Topic(spark, scratch(spark, "topic"))
    t.publish(spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(body)"))
    t.publish(spark.sql("SELECT 'c' AS body"))
    out = [("g1", *r) for r in t.poll("g1", 2).collect()] + [("g1 again", *r) for r in t.poll("g1", 1).collect()]
    t.commit("g1", 2)
    t.commit("g1", 1)
    out += [("g1 after", *r) for r in t.poll("g1", 5).collect()] + [("g2", *r) for r in t.poll("g2", 1).collect()]
    return spark.createDataFrame(out, "who string, pos long, body string")


@query("change_feed", expect("event_id, txn, kind, old, new", (2, 1, "insert", None, '{"k":3,"v":"c"}'), (3, 1, "commit", None, None), (4, 2, "begin", None, None), (5, 2, "update", '{"k":1,"v":"a"}', '{"k":1,"v":"z"}'), (6, 2, "commit", None, None), (7, 3, "begin", None, None), (8, 3, "delete", '{"k":2,"v":"b"}', None), (9, 3, "commit", None, None)))
def change_feed(spark, d):
    t = StoredTable(spark, scratch(spark, "t"), ["k"])
    t.write(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)"))
    feed = Q.ChangeFeed(spark, scratch(spark, "feed"), t)
    t.insert(spark.sql("SELECT 3 AS k, 'c' AS v"))
    t.update(c("k") == 1, {"v": f("z")})
    t.delete(c("k") == 2)
    assert feed.cleanup(1) == 1
    return feed.poll(0, 100)


SCHEMA = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}, "additionalProperties": false}'


@cases("jsonschema_events", "SELECT event_id, props FROM events", "SELECT event_id, (props->>'$.k')::INT <= 50 AS ok, CASE WHEN (props->>'$.k')::INT <= 50 THEN 0 ELSE 1 END AS n FROM events")
def _():
    return {"event_id": c("event_id"), "ok": D.is_valid(c("props"), SCHEMA), "n": F.size(D.validate(c("props"), SCHEMA))}


RULES = (
    ('{"type":["string","null"]}', ("null", '"a"', "1"), [True, True, False]),
    ('{"enum":[1,"a",[2]]}', ("1.0", "[2]", "2"), [True, True, False]),
    ('{"type":"string","pattern":"^a+$","maxLength":3}', ('"aa"', '"aaaa"', '"b"'), [True, False, False]),
    ('{"items":{"type":"number","multipleOf":0.5},"uniqueItems":true,"minItems":1}', ("[1, 1.5]", "[1, 1]", "[]"), [True, False, False]),
    ('{"oneOf":[{"minimum":5},{"multipleOf":2}]}', ("7", "6", "4"), [True, False, True]),
    ('{"if":{"properties":{"t":{"const":1}}},"then":{"required":["x"]},"else":{"required":["y"]}}', ('{"t":1,"x":0}', '{"t":1}', '{"t":2,"y":1}'), [True, False, True]),
    ('{"definitions":{"p":{"type":"integer"}},"properties":{"a":{"$ref":"#/definitions/p"}},"patternProperties":{"^s_":{"type":"string"}},"dependencies":{"a":["b"]}}', ('{"a":1,"b":2}', '{"a":1}', '{"s_x":1}'), [True, False, False]),
    ('{"format":"date","not":{"const":"2024-01-01"}}', ('"2024-02-01"', '"2024-13-01"', '"2024-01-01"'), [True, False, False]),
)


@query("jsonschema_rules", expect("k, ok", *[(i, ok) for i, (_, _, ok) in enumerate(RULES)]))
def jsonschema_rules(spark, d):
    parts = [spark.sql("SELECT :k AS k, :a AS a, :b AS b, :c AS c", {"k": i, "a": docs[0], "b": docs[1], "c": docs[2]}).select("k", F.array(*[D.is_valid(c(x), schema) for x in "abc"]).alias("ok")) for i, (schema, docs, _) in enumerate(RULES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("documents_api", expect("step, result", ("search", "carl,ann"), ("tags", "ann,bob"), ("or", "bob,carl"), ("count", "2"), ("patch", "matched 2 modified 1"), ("get", '{"age": 41, "city": {"name": "Rome"}, "tags": ["x"]}'), ("group", "1:Rome 2:None"), ("remove", "deleted 1"), ("left", "ann,carl"), ("put", '{"age": 1}')))
def documents_api(spark, d):
    col = C.Collection(spark, scratch(spark, "docs"))
    col.insert([{"_id": "ann", "age": 40, "tags": ["x"], "city": {"name": "Rome"}}, {"_id": "bob", "age": 25, "tags": ["x", "y"]}, {"_id": "carl", "age": 51}])
    ids = lambda df: ",".join(r[0] for r in df.collect())
    out = [("search", ids(col.search({"age": {"$gte": 40}}, [("age", -1)]))), ("tags", ids(col.search({"tags": "x"}, [("_id", 1)]).orderBy("_id"))), ("or", ids(col.search({"$or": [{"age": {"$lt": 30}}, {"city": {"$exists": False}}]}).orderBy("_id"))), ("count", str(col.count({"tags": {"$exists": True}})))]
    p = col.patch({"age": {"$gt": 30}}, {"$set": {"seen": 1}, "$unset": {"seen": 1}, "$inc": {"age": 0}})
    q = col.patch({"tags": ["x"]}, {"$inc": {"age": 1}})
    out.append(("patch", f"matched {p['matched']} modified {q['modified']}"))
    out.append(("get", col.get("ann").select(J.canonical(c("data"))).first()[0]))
    out.append(("group", " ".join(f"{r['n']}:{r['value']}" for r in col.group("city.name").orderBy("n").collect())))
    out.append(("remove", f"deleted {col.remove({'_x': 1})['deleted'] + col.remove({'age': 25})['deleted']}"))
    out.append(("left", ids(col.search({}).orderBy("_id"))))
    col.put([{"_id": "carl", "age": 1}])
    out.append(("put", col.get("carl").first()["data"]))
    return spark.createDataFrame(out, "step string, result string")


@query("ratelimit_sliding", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) <= 1 AS allowed FROM events")
def ratelimit_sliding(spark, d):
    return C.sliding_window(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 1, 100).select("event_id", "n", "allowed")


@query("ratelimit_token_bucket", "SELECT user_id, count(*) AS n, true AS bounded FROM events GROUP BY 1")
def ratelimit_token_bucket(spark, d):
    """No more than the bucket and what has flowed in since is ever let through."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    got = C.token_bucket(e, ["user_id"], "ts", "event_id", 5.0, 1.0, 3600.0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = got.withColumn("used", F.sum(c("allowed").cast("int")).over(w)).withColumn("first", F.min("ts").over(Window.partitionBy("user_id")))
    room = 5 + (F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(c("first").cast("timestamp"))) / 3.6e9
    return seen.groupBy("user_id").agg(F.count(f(1)).alias("n"), F.bool_and((c("used") <= room + 1e-6) & (c("tokens") >= 0) & (c("tokens") <= 5)).alias("bounded"))


@query("ratelimit_bucket_steps", expect("t, allowed, tokens", (0, True, 1.0), (1, True, 0.1), (2, False, 0.2), (12, True, 0.2), (100, True, 1.0)))
def ratelimit_bucket_steps(spark, d):
    rows = spark.sql("SELECT 'u' AS u, t, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS at FROM VALUES (0), (1), (2), (12), (100) AS v(t)")
    return C.token_bucket(rows, ["u"], "at", "t", 2.0, 1.0, 10.0).select("t", "allowed", F.round("tokens", 6).alias("tokens"))


@cases("cron_next_run", "SELECT * FROM VALUES ('*/15 * * * *'), ('0 9 * * mon-fri'), ('30 2 29 2 *'), ('0 0 1,15 * 5'), ('@monthly') AS t(s)", expect("s, n", ("*/15 * * * *", "2024-01-06 10:15:00"), ("0 9 * * mon-fri", "2024-01-08 09:00:00"), ("30 2 29 2 *", "2024-02-29 02:30:00"), ("0 0 1,15 * 5", "2024-01-12 00:00:00"), ("@monthly", "2024-02-01 00:00:00")))
def _():
    return {"s": c("s"), "n": D.cron_next(c("s"), f(dt.datetime(2024, 1, 6, 10, 3)))}


@query("chart_svg", expect("kind, marks, titled", ("area", 2, True), ("bar", 5, True), ("line", 1, True), ("pie", 5, True), ("scatter", 5, True)))
def chart_svg(spark, d):
    import re

    rows = [tuple(r) for r in table(spark, d, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").limit(100).collect()]
    out = []
    for kind in ("bar", "line", "area", "scatter", "pie"):
        svg = D.chart(rows, "Nations <by> region", kind)
        out.append((kind, len(re.findall("<(?:rect|circle|path|polyline|polygon)", svg)), "&lt;by&gt;" in svg))
    return spark.createDataFrame(out, "kind string, marks int, titled boolean")


@query("query_store", expect("query, calls", ("select count(*) from orders where o_orderkey < ?", 2), ("select o_orderstatus from orders where o_orderpriority = ?", 1)))
def query_store(spark, d):
    from tessella.plans.registry import views

    views(spark, d, "orders")
    s = C.QueryStore()
    s.run(spark, "SELECT count(*) FROM orders WHERE o_orderkey < 10")
    s.run(spark, "SELECT  count(*) FROM orders WHERE o_orderkey < 20")
    s.run(spark, "SELECT o_orderstatus FROM orders WHERE o_orderpriority = 'x''y'")
    return s.stats(spark).select("query", "calls")


@query("query_advice", expect("name", ("o_custkey",), ("o_orderstatus",)))
def query_advice(spark, d):
    plan = table(spark, d, "orders").filter("o_custkey = 5 and o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    return spark.createDataFrame([(x,) for x in C.QueryStore.advise(plan)], "name string")


@query("query_benchmark", "SELECT 3 AS runs, true AS timed")
def query_benchmark(spark, d):
    ms = C.benchmark(lambda: table(spark, d, "nation"), 3)
    return spark.createDataFrame([(len(ms), all(x > 0 for x in ms))], "runs int, timed boolean")


@query("learned_statistics", "SELECT true AS better")
def learned_statistics(spark, d):
    """Trees learn a count from two features better than its mean does, on rows they haven't seen."""
    x = spark.range(2000).select((c("id") % 40).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), f(30))).cast("double").alias("b"), c("id"))
    x = x.withColumn("n", F.when(c("a") > 20, c("b") * 3).otherwise(c("a")).cast("double"))
    model = C.learn(x.filter("id % 4 > 0"), ["a", "b"], "n", trees=8, depth=4)
    test = model.transform(x.filter("id % 4 = 0"))
    mean = x.agg(F.avg("n").alias("m"))
    return test.crossJoin(mean).agg((F.avg(F.pow(c("prediction") - c("n"), f(2.0))) < 0.2 * F.avg(F.pow(c("m") - c("n"), f(2.0)))).alias("better"))
