"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import timeseries as S
from tessella.plans.registry import query
from tessella.session import scratch, table


@query("time_bucket", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY 1, 2")
def time_bucket(spark, d):
    return table(spark, d, "events").groupBy(S.time_bucket(900, F.col("ts")).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("a"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1")
def window_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


@query(
    "window_sliding",
    """SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS s FROM events) GROUP BY s""",
)
def window_sliding(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


@query(
    "window_session",
    """WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) + 1 AS session FROM f)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""",
)
def window_session(spark, d):
    s = S.sessions(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 3600)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "gap_fill",
    """WITH b AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM events GROUP BY ALL),
    g AS (SELECT t.event_type, x.bucket FROM (SELECT DISTINCT event_type FROM b) t, (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL '1 hour')) AS bucket) x)
    SELECT event_type, bucket, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (event_type, bucket)""",
)
def gap_fill(spark, d):
    b = table(spark, d, "events").groupBy("event_type", S.time_bucket(3600, F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # the bounds are one row, so that nothing runs while the plan is made
    ends = b.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = b.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    return grid.join(b, ["event_type", "bucket"], "left").select("event_type", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '1 day'")
def retention(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return S.retain(e.crossJoin(F.broadcast(now)), "ts", F.col("now"), 86400).select("event_id")


@query("continuous_aggregate", "SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1, 2")
def continuous_aggregate(spark, d):
    """Created on the older rows, refreshed with all of them, read back."""
    e = table(spark, d, "events")
    c = S.ContinuousAggregate(scratch(spark, "aggregate"), "ts", 86400, ["event_type"], {"n": F.count(F.lit(1)), "top": F.round(F.max("value"), 6)})
    half = e.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).cast("timestamp_ntz").alias("m")).first()[0]
    if half is None:
        return c.compute(e)
    since = F.lit(half)
    c.create(e.filter(F.col("ts") < since))
    c.refresh(e, since)
    return c.read(spark)
