"""Distributed and reference tables, balance of shards, statements on every shard, and execution presets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that a vectorized run is made under.
PRESET = {"spark.sql.parquet.enableVectorizedReader": "true", "spark.sql.inMemoryColumnarStorage.enableVectorizedReader": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.adaptive.enabled": "true"}
BROADCAST_BYTES = 64 << 20


def shard_of(df: DataFrame, key: list[str], shards: int) -> DataFrame:
    """``df`` with its shard, by hash of the key."""
    return df.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))


def distribute(df: DataFrame, path: str, key: list[str], shards: int) -> None:
    """One folder a shard; joins of tables with one key and number of shards can be made shard by shard."""
    shard_of(df, key, shards).repartition(shards, "shard").write.partitionBy("shard").parquet(path)


def reference(df: DataFrame, bytes_a_row: int = 100) -> DataFrame:
    """A table that every node gets whole, if its rows are within 64 MiB; else it stays as it is."""
    n = BROADCAST_BYTES // bytes_a_row
    return F.broadcast(df) if df.limit(n + 1).count() <= n else df


def on_all_shards(df: DataFrame, run: Callable) -> DataFrame:
    """shard and result of a function of each shard's Arrow batches; the table is dealt by shard."""

    def each(batches):
        import pyarrow as pa

        by: dict[int, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for s in t.column("shard").unique().to_pylist():
                by.setdefault(s, []).append(t.filter(pa.compute.equal(t.column("shard"), s)))
        for s, parts in sorted(by.items()):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([str(run(pa.concat_tables(parts)))])], names=["shard", "result"])

    return df.repartition("shard").mapInArrow(each, "shard int, result string")


def rebalance(placement: dict[int, str], sizes: dict[int, int], nodes: list[str]) -> list[tuple[int, str, str]]:
    """Moves (shard, from, to) that even out the bytes of nodes, the fewest first: a shard goes from the fullest node to the emptiest
    as long as that lessens their difference. Shards on nodes that are gone move first."""
    place, moves = dict(placement), []
    load = {n: sum(sizes[s] for s, p in place.items() if p == n) for n in nodes}
    for s in sorted(s for s, p in place.items() if p not in load):
        to = min(nodes, key=lambda n: (load[n], n))
        moves.append((s, place[s], to))
        place[s], load[to] = to, load[to] + sizes[s]
    while True:
        full, empty = max(nodes, key=lambda n: (load[n], n)), min(nodes, key=lambda n: (load[n], n))
        gap = load[full] - load[empty]
        fits = [s for s, p in place.items() if p == full and 0 < sizes[s] < gap]
        if not fits:
            return moves
        s = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        moves.append((s, full, empty))
        place[s] = empty
        load[full], load[empty] = load[full] - sizes[s], load[empty] + sizes[s]


def vectorize_query(spark: SparkSession, sql: str) -> DataFrame:
    """A statement planned under the preset; the session's own settings are put back."""
    old = {k: spark.conf.get(k, None) for k in PRESET}
    try:
        for k, v in PRESET.items():
            spark.conf.set(k, v)
        out = spark.sql(sql)
        out._jdf.queryExecution().executedPlan()
        return out
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def vectorize_explain(spark: SparkSession, sql: str) -> str:
    return vectorize_query(spark, sql)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def vectorize_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, str(spark.conf.get(k, None)), v) for k, v in sorted(PRESET.items())], "name string, session string, preset string")
