"""Mergeable sketches as aggregates: counts, heavy hitters, membership, quantiles.

Each is a table of small parts (cells, counters, bits, centroids), made by partial aggregation, and sketches of parts of the
data merge to that of the whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.base import DOUBLE, rowwise

# -- counts -------------------------------------------------------------------------------------


class CountMin:
    """Counts that never fall short: a cell for each of ``depth`` hash functions. With width w an estimate exceeds
    the count by more than e / w of all rows with probability e**-depth at most."""

    def __init__(self, width: int = 2000, depth: int = 5, seed: int = 0) -> None:
        if not (0 < width <= 1_000_000 and 0 < depth <= 20):
            raise ValueError("width up to 1,000,000 and depth up to 20")
        self.width, self.depth, self.seed = width, depth, seed

    def _cell(self, value: Column, row: Column) -> Column:
        return F.pmod(F.xxhash64(row, F.lit(self.seed), value), F.lit(self.width)).cast("int")

    def create(self, df: DataFrame, value: Column, *by: str) -> DataFrame:
        """(by ..., row, cell, n): depth * width rows a group at most."""
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), self._cell(value, F.lit(i)).alias("cell")) for i in range(self.depth)]))
        return df.filter(value.isNotNull()).select(*by, at.alias("x")).groupBy(*by, "x.row", "x.cell").agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = [c for c in a.columns if c != "n"]
        return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))

    def estimate(self, sketch: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """``values`` with their estimates."""
        asked = values.select(value, F.explode(F.array(*[F.struct(F.lit(i).alias("row"), self._cell(F.col(value), F.lit(i)).alias("cell")) for i in range(self.depth)])).alias("x")).select(value, "x.*")
        got = asked.join(sketch, ["row", "cell"], "left")
        return got.groupBy(value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


# -- heavy hitters ------------------------------------------------------------------------------


def top_k(df: DataFrame, value: str, k: int, counters: int | None = None) -> DataFrame:
    """value and count of the k most frequent values by a bounded number of counters: those of each task are cut to ``counters`` with
    the greatest cut count as error, and merged. A value above rows / counters is in the result; count exceeds the truth by error at most."""
    counters = counters or max(10 * k, 1000)
    kind = df.schema[value].dataType
    item = T.StructType([T.StructField("item", kind), T.StructField("n", T.LongType())])

    def part(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        held: dict = {}
        for b in batches:
            for v in b.column(0).to_pylist():
                if v is None:
                    continue
                if v in held:
                    held[v][0] += 1
                elif len(held) < 2 * counters:
                    held[v] = [1, 0]
                else:  # keep the larger half; what comes later may have had as many as the greatest that went
                    order = sorted(held.items(), key=lambda x: (-x[1][0], str(x[0])))
                    floor = order[counters][1][0]
                    held = dict(order[:counters])
                    held[v] = [floor + 1, floor]
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array([held[x][0] for x in keys], pa.int64()), pa.array([held[x][1] for x in keys], pa.int64())], names=["item", "n", "error"])

    schema = T.StructType([*item.fields, T.StructField("error", T.LongType())])
    parts = df.select(value).mapInArrow(part, schema)
    return parts.groupBy("item").agg(F.sum("n").alias("count"), F.sum("error").alias("error")).orderBy(F.col("count").desc(), "item").limit(k).select(F.col("item").alias(value), "count", "error")


# -- membership ---------------------------------------------------------------------------------


class Bloom:
    """Bits for n expected values at a false positive rate p: m = ceil(-n ln p / ln(2)**2) bits, k = round(m / n ln 2)
    hash functions, 1 to 30. A value that was added is always found."""

    def __init__(self, n: int, p: float = 0.01) -> None:
        if not 0 < p < 1:
            raise ValueError("the rate lies between 0 and 1")
        self.m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.k = min(30, max(1, round(self.m / max(n, 1) * math.log(2))))

    def positions(self, value: Column) -> Column:
        """By double hashing."""
        a, b = F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value).bitwiseOR(F.lit(1))
        return F.array(*[F.pmod(F.pmod(a, F.lit(self.m)) + F.lit(i) * F.pmod(b, F.lit(self.m)) + F.lit(i * i), F.lit(self.m)) for i in range(self.k)])

    def create(self, df: DataFrame, value: Column) -> DataFrame:
        """(word, bits): 64 bits a row, set bits only."""
        at = df.filter(value.isNotNull()).select(F.explode(self.positions(value)).alias("p"))
        return at.groupBy(F.floor(F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def contains(self, sketch: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """``values`` and whether each may have been added: null is in nothing."""
        asked = values.select(value).distinct().select(value, F.explode(self.positions(F.col(value))).alias("p")).withColumn("word", F.floor(F.col("p") / 64).cast("long"))
        hit = F.coalesce(F.getbit(F.col("bits"), (F.col("p") % 64).cast("int")) == 1, F.lit(False))
        found = asked.join(sketch, "word", "left").groupBy(value).agg(F.bool_and(hit).alias("found"))
        return found.withColumn("found", F.col("found") & F.col(value).isNotNull())

    def stats(self, sketch: DataFrame) -> DataFrame:
        """bits, hashes, set_bits, fill and the rate at this fill."""
        s = sketch.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("set_bits"))
        return s.select(F.lit(self.m).alias("bits"), F.lit(self.k).alias("hashes"), "set_bits", (F.col("set_bits") / self.m).alias("fill"), F.pow(F.col("set_bits") / self.m, F.lit(float(self.k))).alias("rate"))


# -- quantiles ----------------------------------------------------------------------------------

CENTROIDS = T.ArrayType(T.StructType([T.StructField("mean", DOUBLE), T.StructField("weight", DOUBLE)]))


def _compress(points: list[tuple[float, float]], compression: int) -> list[tuple[float, float]]:
    """Centroids whose weights are bounded by their place: small at both ends."""
    points = sorted(points)
    total = sum(w for _, w in points)
    out: list[list[float]] = []
    before = 0.0
    k = lambda q: compression / (2 * math.pi) * math.asin(2 * min(max(q, 0.0), 1.0) - 1)
    for mean, w in points:
        if out and k((before + w) / total) - k((before - out[-1][1]) / total) <= 1:
            m, v = out[-1]
            out[-1] = [m + (mean - m) * w / (v + w), v + w]
        else:
            out.append([mean, w])
        before += w
    return [(m, w) for m, w in out]


class TDigest:
    """Centroids of values: create, merge, quantile and cdf. A task's values are digested where they are read."""

    def __init__(self, compression: int = 100) -> None:
        self.compression = compression

    def create(self, df: DataFrame, value: Column, *by: str) -> DataFrame:
        """(by ..., digest): parts of up to 50,000 values are digested before groups are dealt."""
        compression, fields = self.compression, [df.schema[b] for b in by]
        schema = T.StructType([*fields, T.StructField("part", CENTROIDS)])

        def part(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            held: dict[tuple, list] = {}

            def rows(groups):
                keys = list(groups)
                cols = [pa.array([k[i] for k in keys], to_arrow_schema(schema).field(i).type) for i in range(len(by))]
                parts = [[{"mean": m, "weight": w} for m, w in _compress(groups[k], compression)] for k in keys]
                return pa.RecordBatch.from_arrays([*cols, pa.array(parts, to_arrow_schema(schema).field(len(by)).type)], names=[f.name for f in schema.fields])

            for b in batches:
                for *key, v in zip(*(c.to_pylist() for c in b.columns)):
                    points = held.setdefault(tuple(key), [])
                    points.append((v, 1.0))
                    if len(points) >= 50_000:
                        held[tuple(key)] = _compress(points, compression)
                if len(held) > 10_000:
                    yield rows(held)
                    held = {}
            if held:
                yield rows(held)

        parts = df.filter(value.isNotNull()).select(*by, value.cast("double").alias("v")).mapInArrow(part, schema)
        return self._gather(parts, by)

    def _gather(self, parts: DataFrame, by) -> DataFrame:
        compression = self.compression
        squeeze = rowwise(lambda ps: [{"mean": m, "weight": w} for m, w in _compress([(c["mean"], c["weight"]) for p in ps for c in p], compression)], CENTROIDS)
        return parts.groupBy(*by).agg(F.collect_list("part").alias("parts")).select(*by, squeeze(F.col("parts")).alias("digest"))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        by = [c for c in a.columns if c != "digest"]
        return self._gather(a.unionByName(b).withColumnRenamed("digest", "part"), by)

    @staticmethod
    def quantile(digest: Column, q: float) -> Column:
        return rowwise(lambda d: _quantile([(c["mean"], c["weight"]) for c in d], q), DOUBLE)(digest)

    @staticmethod
    def cdf(digest: Column, x: float) -> Column:
        return rowwise(lambda d: _cdf([(c["mean"], c["weight"]) for c in d], x), DOUBLE)(digest)


def _quantile(points: list[tuple[float, float]], q: float) -> float | None:
    if not points:
        return None
    total = sum(w for _, w in points)
    at, before = q * total, 0.0
    last = None
    for mean, w in points:
        mid = before + w / 2
        if at <= mid:
            if last is None:
                return mean
            m0, c0 = last
            return m0 + (mean - m0) * (at - c0) / (mid - c0)
        last, before = (mean, mid), before + w
    return points[-1][0]


def _cdf(points: list[tuple[float, float]], x: float) -> float | None:
    if not points:
        return None
    total = sum(w for _, w in points)
    before, last = 0.0, None
    for mean, w in points:
        mid = before + w / 2
        if x < mean:
            if last is None:
                return 0.0
            m0, c0 = last
            return (c0 + (mid - c0) * (x - m0) / (mean - m0)) / total
        last, before = (mean, mid), before + w
    return 1.0
