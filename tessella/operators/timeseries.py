"""Time series: buckets, gaps, sessions, retention, continuous aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(width_s: int, at: Column, origin_s: int = 0) -> Column:
    """The start of the bucket of ``width_s`` seconds, counted from the epoch or ``origin_s``."""
    micros = F.unix_micros(at.cast("timestamp"))
    w, o = width_s * 1_000_000, origin_s * 1_000_000
    return F.timestamp_micros(micros - F.pmod(micros - o, F.lit(w))).cast("timestamp_ntz")


def gap_fill(df: DataFrame, by: list[str], at: str, width_s: int, start: Column, end: Column) -> DataFrame:
    """A row for each key and each time from start to end (inclusive) by ``width_s``; what ``df`` has there, else nulls."""
    grid = df.select(*by).distinct().withColumn(at, F.explode(F.sequence(start, end, F.make_dt_interval(secs=F.lit(float(width_s))))))
    return grid.join(df, [*by, at], "left")


def sessions(df: DataFrame, by: list[str], at: str, gap_s: float) -> DataFrame:
    """``df`` with session, counting from 1 in each key; a pause of more than ``gap_s`` seconds begins one."""
    w = Window.partitionBy(*by).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(micros - F.lag(micros).over(w) > gap_s * 1_000_000, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)) + 1).drop("__new")


def retain(df: DataFrame, at: str, now: Column, keep_s: int) -> DataFrame:
    """Rows not older than ``keep_s`` seconds."""
    return df.filter(F.col(at) >= (now - F.make_dt_interval(secs=F.lit(float(keep_s)))))


class ContinuousAggregate:
    """A stored aggregate by time bucket. ``refresh`` computes the buckets from a watermark on anew and takes the finished
    ones from the last version, so that the raw rows it reads are the new ones. A version is a folder of its own and
    counts once it is complete, so that readers see whole states only and buckets that have gone empty go."""

    def __init__(self, path: str, at: str, width_s: int, by: list[str], aggs: dict[str, Column]) -> None:
        self.path, self.at, self.width_s, self.by, self.aggs = path.rstrip("/"), at, width_s, by, aggs

    def compute(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.by, time_bucket(self.width_s, F.col(self.at)).alias("bucket")).agg(*[v.alias(k) for k, v in self.aggs.items()])

    def versions(self, spark) -> list[int]:
        """Numbers of the complete versions."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def create(self, df: DataFrame) -> None:
        self._write(self.compute(df))

    def refresh(self, df: DataFrame, since: Column) -> None:
        """Rows of ``df`` before the bucket of ``since`` count as they did before."""
        cut = time_bucket(self.width_s, since)
        fresh = self.compute(df.filter(F.col(self.at) >= cut))
        self._write(self.read(df.sparkSession).filter(F.col("bucket") < cut).unionByName(fresh))

    def _write(self, out: DataFrame) -> None:
        last = max(self.versions(out.sparkSession), default=0)
        out.write.parquet(f"{self.path}/v{last + 1}")

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{self.versions(spark)[-1]}")

    def status(self, spark) -> DataFrame:
        """versions, buckets, first_bucket, last_bucket."""
        return self.read(spark).agg(F.lit(len(self.versions(spark))).alias("versions"), F.count_distinct("bucket").alias("buckets"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))

    def drop(self, spark) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
