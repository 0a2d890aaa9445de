"""Queues with visibility timeouts, topics with consumer groups, change feeds, notifications: stored tables, changed by joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.kinds import sequence_values
from tessella.sources.tables import Change, StoredTable


class Queue:
    """Messages that are hidden once received, until they are acknowledged, given back or their time is up. After ``most`` deliveries a
    message is dead. ``now`` is a parameter, so that runs can be repeated."""

    def __init__(self, spark: SparkSession, path: str, visibility_s: int = 30, most: int = 5) -> None:
        self.spark, self.table, self.visibility_s, self.most = spark, StoredTable(spark, path, ["id"]), visibility_s, most
        if not self.table.versions():
            self.table.write(spark.createDataFrame([], "id long, body string, visible_at timestamp_ntz, delivery_count int, state string"))

    def send(self, rows: DataFrame, now: dt.datetime, body: str = "body", delay_s: int = 0) -> None:
        """Ids go on from the last one, in the order of bodies."""
        old = self.table.read()
        last = old.agg(F.max("id")).first()[0] or 0
        new = sequence_values(rows.select(F.col(body).alias("body")), "id", ["body"], last + 1)
        at = now + dt.timedelta(seconds=delay_s)
        self.table.insert(new.select("id", "body", F.lit(at).alias("visible_at"), F.lit(0).alias("delivery_count"), F.lit("ready").alias("state")))

    def receive(self, n: int, now: dt.datetime) -> DataFrame:
        """The first n visible messages, hidden from now on."""
        dead = (F.col("state") == "ready") & (F.col("visible_at") <= F.lit(now)) & (F.col("delivery_count") >= self.most)
        if self.table.read().filter(dead).limit(1).count():
            self.table.update(dead, {"state": F.lit("dead")})
        visible = self.table.read().filter((F.col("state") == "ready") & (F.col("visible_at") <= F.lit(now))).orderBy("id").limit(n).select("id")
        until = now + dt.timedelta(seconds=self.visibility_s)
        out = self.table.merge(visible, [(None, "update", {"visible_at": F.lit(until), "delivery_count": F.col("t.delivery_count") + 1})], [])
        return out.select("new.*").orderBy("id")

    def ack(self, ids: list[int]) -> None:
        self.table.delete(F.col("id").isin(ids))

    def nack(self, ids: list[int], now: dt.datetime) -> None:
        """Visible again at once."""
        self.table.update(F.col("id").isin(ids) & (F.col("state") == "ready"), {"visible_at": F.lit(now)})

    def stats(self, now: dt.datetime) -> DataFrame:
        here = F.col("visible_at") <= F.lit(now)
        return self.table.read().agg(F.count_if((F.col("state") == "ready") & here).alias("ready"), F.count_if((F.col("state") == "ready") & ~here).alias("in_flight"), F.count_if(F.col("state") == "dead").alias("dead"))


class Topic:
    """Rows with offsets, and a committed offset for each group: what isn't committed is read again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log, self.groups = spark, StoredTable(spark, f"{path}/log", ["offset"]), StoredTable(spark, f"{path}/groups", ["name"])
        if not self.log.versions():
            self.log.write(spark.createDataFrame([], "offset long, body string"))
            self.groups.write(spark.createDataFrame([], "name string, offset long"))

    def publish(self, rows: DataFrame, body: str = "body") -> None:
        last = self.log.read().agg(F.max("offset")).first()[0] or 0
        self.log.insert(sequence_values(rows.select(F.col(body).alias("body")), "offset", ["body"], last + 1).select("offset", "body"))

    def committed(self, group: str) -> int:
        row = self.groups.read().filter(F.col("name") == group).first()
        return row["offset"] if row else 0

    def poll(self, group: str, n: int) -> DataFrame:
        """What follows the committed offset. Reading commits nothing (peek); ``commit`` does."""
        return self.log.read().filter(F.col("offset") > self.committed(group)).orderBy("offset").limit(n)

    def commit(self, group: str, offset: int) -> None:
        self.groups.upsert(self.spark.createDataFrame([(group, offset)], "name string, offset long"), {"offset": F.greatest("t.offset", "excluded.offset")})


class ChangeFeed:
    """A trigger that appends what changes to a feed, with poll and cleanup by event id; begin and commit frame each statement."""

    def __init__(self, spark: SparkSession, path: str, table: StoredTable) -> None:
        self.spark, self.feed = spark, StoredTable(spark, path, ["event_id"])
        self.feed.write(spark.createDataFrame([], "event_id long, txn long, kind string, old string, new string"))
        self.txn = 0
        for event in ("insert", "update", "delete"):
            table.on(event, self._note, "before")

    def _note(self, change: Change) -> None:
        self.txn += 1
        js = lambda: F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        none = F.lit(None).cast("string")
        if change.event == "update":
            key = change.old.columns[0]
            a, b = change.old.select(F.col(key).alias("k"), js().alias("old")), change.new.select(F.col(key).alias("k"), js().alias("new"))
            rows = a.join(b, "k").select("old", "new")
        elif change.event == "insert":
            rows = change.new.select(none.alias("old"), js().alias("new"))
        else:
            rows = change.old.select(js().alias("old"), none.alias("new"))
        frame = self.spark.createDataFrame([("0begin",), ("2commit",)], "o string").select("o", none.alias("old"), none.alias("new"))
        rows = rows.select(F.lit("1change").alias("o"), "old", "new").unionByName(frame)
        last = self.feed.read().agg(F.max("event_id")).first()[0] or 0
        numbered = sequence_values(rows, "event_id", ["o", "old", "new"], last + 1)
        kind = F.when(F.col("o") == "1change", F.lit(change.event)).otherwise(F.substring("o", F.lit(2), F.lit(10)))
        self.feed.insert(numbered.select("event_id", F.lit(self.txn).cast("long").alias("txn"), kind.alias("kind"), "old", "new"))

    def poll(self, after: int, n: int) -> DataFrame:
        return self.feed.read().filter(F.col("event_id") > after).orderBy("event_id").limit(n)

    def cleanup(self, upto: int) -> int:
        """Events up to an id go; gives how many."""
        return self.feed.delete(F.col("event_id") <= upto).count()


class Channels:
    """LISTEN and NOTIFY within a driver: equal notifications of one batch are one."""

    def __init__(self) -> None:
        self.listeners: dict[str, list[Callable[[str], None]]] = {}

    def listen(self, channel: str, f: Callable[[str], None]) -> None:
        self.listeners.setdefault(channel, []).append(f)

    def unlisten(self, channel: str) -> None:
        self.listeners.pop(channel, None)

    def notify(self, channel: str, *payloads: str) -> None:
        for p in dict.fromkeys(payloads):
            for f in self.listeners.get(channel, ()):
                f(p)

    def sink(self, channel: str, limit: int = 1000) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the distinct ``payload`` values of a batch, up to ``limit``, beyond which it is an error."""

        def put(df: DataFrame, no: int) -> None:
            got = [r[0] for r in df.select("payload").distinct().limit(limit + 1).collect()]
            if len(got) > limit:
                raise ValueError("too many notifications")
            self.notify(channel, *sorted(got))

        return put
