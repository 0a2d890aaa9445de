"""Structured Streaming: sources, windows, duplicates, joins, state, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import scratch


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder that files are added to, as a stream; Parquet."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def tumbling(stream: DataFrame, at: str, width: str, late: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates by window; rows later than ``late`` behind the latest are left out, and in append mode a window is
    given once when none can come any more."""
    return sliding(stream, at, width, width, late, by, aggs)


def sliding(stream: DataFrame, at: str, width: str, slide: str, late: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    w = F.window(F.col(at), width, slide).alias("w")
    return stream.withWatermark(at, late).groupBy(w, *by).agg(*[v.alias(k) for k, v in aggs.items()]).select("w.start", "w.end", *by, *aggs)


def session(stream: DataFrame, at: str, gap: str, late: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    w = F.session_window(F.col(at), gap).alias("w")
    return stream.withWatermark(at, late).groupBy(w, *by).agg(*[v.alias(k) for k, v in aggs.items()]).select("w.start", "w.end", *by, *aggs)


def deduplicate(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; keys are kept for ``late`` behind the latest row, so that state is bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def join_streams(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of both with one key and ``right_at`` up to ``within`` after ``left_at``: both sides' state is bounded by this."""
    a, b = left.withWatermark(left_at, late).alias("a"), right.withWatermark(right_at, late).alias("b")
    cond = (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col(f"b.{right_at}") >= F.col(f"a.{left_at}")) & (F.col(f"b.{right_at}") <= F.col(f"a.{left_at}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, cond, how)


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and total so far, a row for each key that a batch touches: state of one's own, in pandas batches."""

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, label: str, each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over what its source holds, in its micro-batches. Append goes to files; for complete and
    update, ``each`` gets a batch (complete: the last one overwrites). Gives the folder."""
    spark = stream.sparkSession
    out, mark = scratch(spark, label), scratch(spark, f"{label}-checkpoint")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
    if mode == "append" and each is None:
        q = w.format("parquet").option("path", out).start()
    else:
        put = each or (lambda df, no: df.write.mode("overwrite").parquet(out) if mode == "complete" else df.withColumn("batch", F.lit(no)).write.mode("append").parquet(out))
        q = w.foreachBatch(put).start()
    q.awaitTermination()
    return out
