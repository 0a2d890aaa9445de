"""Collections of JSON documents, rate limits, query statistics, regression trees on statistics, model inference."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import documents as D
from tessella.functions import jsonb as J
from tessella.functions.base import BOOL, STRING, rowwise
from tessella.sources.tables import StoredTable


class Collection:
    """Documents by ``_id``, which is taken from the document or made up, and isn't stored in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, StoredTable(spark, path, ["_id"])
        if not self.table.versions():
            self.table.write(spark.createDataFrame([], "_id string, data string"))

    def insert(self, docs: list[dict] | DataFrame) -> DataFrame:
        """Documents, or a table with a column ``doc``; gives their ids. An id that is there already is an error."""
        return self.table.insert(self._rows(docs)).select("_id")

    def put(self, docs: list[dict] | DataFrame) -> None:
        """In place of what has the same id."""
        self.table.upsert(self._rows(docs), {"data": F.col("excluded.data")})

    def _rows(self, docs) -> DataFrame:
        if isinstance(docs, list):
            docs = self.spark.createDataFrame([(json.dumps({"_id": str(uuid.uuid4()), **d}),) for d in docs], "doc string")
        given = J.arrow_text(F.col("doc"), "_id")
        return docs.select(F.coalesce(given, F.md5("doc")).alias("_id"), J.delete(F.col("doc"), "_id").alias("data"))

    def read(self) -> DataFrame:
        return self.table.read()

    def get(self, key: str) -> DataFrame:
        return self.read().filter(F.col("_id") == key)

    @staticmethod
    def _fits(query: dict) -> Column:
        text = json.dumps(query)
        return rowwise(lambda d: D.fits(J.load(d), J.load(text)), BOOL)(F.col("data")) if query else F.lit(True)

    def search(self, query: dict, sort: list[tuple[str, int]] = (), limit: int | None = None, offset: int = 0, projection: list[str] | None = None) -> DataFrame:
        out = self.read().filter(self._fits(query))
        if sort:
            keys = []
            for field, way in sort:
                v = J.extract_path(F.col("data"), F.lit(field.split(".")))
                k = [F.get_json_object("data", f"$.{field}").try_cast("double"), v]
                keys += [x.asc() if way > 0 else x.desc() for x in k]
            out = out.orderBy(*keys, "_id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
        if projection:
            names = list(projection)
            out = out.select("_id", rowwise(lambda d: J.dump({k: v for k, v in J.load(d).items() if k in names}), STRING)(F.col("data")).alias("data"))
        return out

    def count(self, query: dict) -> int:
        return self.read().filter(self._fits(query)).count()

    def patch(self, query: dict, changes: dict) -> dict:
        """$set, $unset, $inc, $push, $pull; gives matched and modified."""
        text = json.dumps(changes)
        new = rowwise(lambda d: J.dump(_patched(J.load(d), J.load(text))), STRING)(F.col("data"))
        pairs = self.table.update(self._fits(query), {"data": new})
        got = pairs.agg(F.count(F.lit(1)), F.count_if(J.canonical(F.col("old.data")) != F.col("new.data"))).first()
        return {"matched": got[0], "modified": got[1]}

    def remove(self, query: dict) -> dict:
        return {"deleted": self.table.delete(self._fits(query)).count()}

    def group(self, field: str, query: dict | None = None) -> DataFrame:
        v = J.extract_path_text(F.col("data"), F.lit(field.split(".")))
        return self.read().filter(self._fits(query or {})).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _patched(doc: dict, changes: dict) -> dict:
    for op, fields in changes.items():
        for key, x in fields.items():
            *way, last = key.split(".")
            at = doc
            for k in way:
                at = at.setdefault(k, {})
            if op == "$set":
                at[last] = x
            elif op == "$unset":
                at.pop(last, None)
            elif op == "$inc":
                at[last] = at.get(last, 0) + x
            elif op == "$push":
                at[last] = at.get(last, []) + [x]
            elif op == "$pull":
                at[last] = [v for v in at.get(last, []) if not D._same(v, x)]
            else:
                raise ValueError(op)
    return doc


# -- rate limits --------------------------------------------------------------------------------


def sliding_window(events: DataFrame, by: list[str], at: str, most: int, window_s: int) -> DataFrame:
    """``events`` with n (those of the key in the seconds up to the row's own, itself included) and allowed. The window is held
    to 1 to 60 seconds."""
    w = max(1, min(60, window_s))
    second = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000)
    over = Window.partitionBy(*by).orderBy(second).rangeBetween(-(w - 1), 0)
    n = F.count(F.lit(1)).over(over)
    return events.withColumn("n", n).withColumn("allowed", F.col("n") <= most)


def token_bucket(events: DataFrame, by: list[str], at: str, order: str, capacity: float, refill: float, interval_s: float) -> DataFrame:
    """``events`` with allowed and tokens: a bucket starts full, gains refill / interval_s a second up to its capacity, and an event takes
    one if there is one. A key's events pass in order, in Arrow batches that carry the state on, so a key of any length is
    read as a stream."""
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType())])
    micros = "__micros"
    sorted_ = events.withColumn(micros, F.unix_micros(F.col(at).cast("timestamp"))).repartition(*by).sortWithinPartitions(*by, micros, order)
    key_at = [events.columns.index(b) for b in by]

    def run(batches):
        import pyarrow as pa

        key, tokens, last = None, capacity, 0
        for b in batches:
            allowed, left = [], []
            for *k, t in zip(*(b.column(i).to_pylist() for i in key_at), b.column(b.num_columns - 1).to_pylist()):
                if k != key:
                    key, tokens, last = k, capacity, t
                tokens = min(capacity, tokens + (t - last) / 1e6 / interval_s * refill)
                last = t
                ok = tokens >= 1.0
                tokens -= ok
                allowed.append(ok), left.append(tokens)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], names=[f.name for f in schema.fields])

    return sorted_.mapInArrow(run, schema)


# -- queries about queries ----------------------------------------------------------------------


class QueryStore:
    """Statements by their fingerprint (numbers and texts are left out), with calls and times."""

    def __init__(self) -> None:
        self.entries: dict[str, list] = {}

    @staticmethod
    def fingerprint(sql: str) -> str:
        import re

        s = re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", sql)
        return " ".join(s.split()).lower()

    def run(self, spark: SparkSession, sql: str) -> DataFrame:
        start = time.monotonic()
        out = spark.sql(sql)
        out.write.format("noop").mode("overwrite").save()
        took = (time.monotonic() - start) * 1000
        e = self.entries.setdefault(self.fingerprint(sql), [0, 0.0, 0.0])
        e[0], e[1], e[2] = e[0] + 1, e[1] + took, max(e[2], took)
        return out

    def stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, n, total, total / n, most) for k, (n, total, most) in self.entries.items()], "query string, calls long, total_ms double, mean_ms double, max_ms double")

    @staticmethod
    def advise(plan: str) -> list[str]:
        """Columns that scans are filtered by: candidates for partitioning, bucketing or sorting of files."""
        import re

        return sorted({c for line in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for c in re.findall(r"(?:EqualTo|GreaterThan|LessThan|GreaterThanOrEqual|LessThanOrEqual|In)\(([A-Za-z_]\w*)", line)})


def benchmark(run: Callable[[], DataFrame], iterations: int = 10) -> list[float]:
    """Milliseconds of each of 1 to 10,000 runs."""
    if not 1 <= iterations <= 10_000:
        raise ValueError("iterations must be between 1 and 10000")
    out = []
    for _ in range(iterations):
        start = time.monotonic()
        run().write.format("noop").mode("overwrite").save()
        out.append((time.monotonic() - start) * 1000)
    return out


# -- models -------------------------------------------------------------------------------------


def learn(samples: DataFrame, features: list[str], label: str, trees: int = 32, depth: int = 6, rate: float = 0.1, least: int = 64):
    """Boosted regression trees on up to eight features and 64 samples or more: a fitted model, to be used by ``transform``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    if len(features) > 8 or samples.limit(least).count() < least:
        raise ValueError(f"eight features and {least} samples")
    gbt = GBTRegressor(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), gbt]).fit(samples)


def infer(df: DataFrame, model: bytes, column: str, batch_rows: int = 1024) -> DataFrame:
    """``df`` with output, what an ONNX model gives for the vectors of a column: the model is sent once to each executor and
    opened once in each of its workers, and runs on batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField("output", T.ArrayType(T.FloatType()))])
    at = df.columns.index(column)

    def run(batches):
        import numpy as np
        import onnxruntime as ort
        import pyarrow as pa

        session = ort.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for b in batches:
            for i in range(0, b.num_rows, batch_rows):
                part = b.slice(i, batch_rows)
                x = np.array(part.column(at).to_pylist(), np.float32)
                y = np.asarray(session.run(None, {name: x})[0], np.float32).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y.tolist(), pa.list_(pa.float32()))], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
