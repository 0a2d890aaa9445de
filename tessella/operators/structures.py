"""Trees from parent links, cross tables, series in period folders, columns that a change fills in, references, large objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import numbers
from tessella.session import materialize


def connect_by(df: DataFrame, key: str, parent: str, start, max_depth: int = 0, delimiter: str = "~", order: str | None = None) -> DataFrame:
    """key, parent, level, branch (the keys from the start on) and serial, the row's place depth first, siblings by ``order`` or key.
    A key that comes again on its own branch is an error. ``max_depth`` 0 has no bound."""
    kind = df.schema[key].dataType
    e = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), F.col(order or key).alias("__o")).filter("__p is not null")
    fresh = df.filter(F.col(key) == F.lit(start)).select(F.col(key).alias("key"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level"), F.array(key).alias("way"), F.array(F.col(order or key)).alias("place"))
    out, level = fresh, 0
    while not max_depth or level < max_depth:
        level += 1
        step = fresh.join(e, F.col("key") == F.col("__p"))
        step = step.select(F.col("__k").alias("key"), F.col("__p").alias("parent"), F.lit(level).alias("level"), F.concat("way", F.array("__k")).alias("way"), F.concat("place", F.array("__o")).alias("place"), F.array_contains("way", F.col("__k")).alias("again"))
        fresh = materialize(step, "tree")
        if not fresh.limit(1).count():
            break
        if fresh.filter("again").limit(1).count():
            raise RuntimeError("infinite recursion detected")
        fresh = fresh.drop("again")
        out = out.unionByName(fresh)
    text = F.array_join(F.transform("way", lambda x: x.cast("string")), delimiter)
    from pyspark.sql import Window

    return out.select("key", "parent", "level", text.alias("branch"), F.row_number().over(Window.orderBy("place")).alias("serial"))


def crosstab(df: DataFrame, row: str, category: str, value: str, n: int, order: str | None = None) -> DataFrame:
    """row and category_1 ... category_n: the first n values of each row by category, side by side without regard to which category."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order or category).alias("o"), F.col(category).alias("c"), F.col(value).alias("v"))))
    return df.groupBy(row).agg(rows.alias("r")).select(row, *[F.get("r", F.lit(i))["v"].alias(f"category_{i + 1}") for i in range(n)])


def crosstab_by(df: DataFrame, row: str, category: str, value: str, categories: list) -> DataFrame:
    """A column for each of the given categories."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(category) == c, F.col(value))).alias(str(c)) for c in categories])


def normal_rand(spark: SparkSession, n: int, mean: float, stddev: float, seed: int) -> DataFrame:
    """n normal numbers."""
    return spark.range(n).select(numbers.random_normal(seed, F.col("id"), mean=mean, stddev=stddev).alias("value"))


class PeriodFolders:
    """A series in one folder a period (yyyy, yyyy-MM or yyyy-MM-dd), which come by appending and go by age."""

    def __init__(self, spark: SparkSession, path: str, at: str, form: str = "yyyy-MM") -> None:
        self.spark, self.path, self.at, self.form = spark, path.rstrip("/"), at, form

    def append(self, df: DataFrame) -> None:
        part = df.withColumn("period", F.date_format(self.at, self.form))
        part.repartition("period").write.mode("append").partitionBy("period").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("period", F.col("period").cast("string"))

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = p(self.path)
        return p, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def periods(self) -> list[str]:
        _, fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("period="))

    def drop_before(self, period: str) -> list[str]:
        """Whole folders go; nothing is rewritten. Gives their periods."""
        p, fs, _ = self._fs()
        gone = [x for x in self.periods() if x < period]
        for x in gone:
            fs.delete(p(f"{self.path}/period={x}"), True)
        return gone


def stamped(rows: DataFrame, user: str, now: Column, name_column: str | None = None, time_column: str | None = None) -> DataFrame:
    """Rows with who changed them and when, before they are written."""
    out = rows.withColumn(name_column, F.lit(user)) if name_column else rows
    return out.withColumn(time_column, now) if time_column else out


def orphans(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows that refer to nothing: what a foreign key refuses. A null in the key refers to nothing on purpose."""
    on = F.lit(True)
    known = F.lit(True)
    p = parent.select(*[F.col(b).alias(f"__{b}") for _, b in keys]).distinct()
    for a, b in keys:
        on = on & (F.col(a) == F.col(f"__{b}"))
        known = known & F.col(a).isNotNull()
    return child.filter(known).join(p, on, "left_anti")


class LargeObjects:
    """Bytes in pages of a table (id, page, data), read by ranges."""

    PAGE = 2048

    @classmethod
    def put(cls, spark: SparkSession, objects: list[tuple[int, bytes]]) -> DataFrame:
        rows = [(i, n, b[n * cls.PAGE : (n + 1) * cls.PAGE]) for i, b in objects for n in range(max(1, -(-len(b) // cls.PAGE)))]
        return spark.createDataFrame(rows, "id long, page long, data binary")

    @classmethod
    def get(cls, pages: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
        """id and data from an offset on."""
        last = F.lit(True) if size is None else F.col("page") <= (offset + size - 1) // cls.PAGE
        some = pages.filter((F.col("page") >= offset // cls.PAGE) & last)
        joined = F.expr("unhex(array_join(transform(sort_array(collect_list(struct(page, hex(data)))), x -> x.col2), ''))")
        skip = offset % cls.PAGE
        cut = lambda b: F.substring(b, F.lit(skip + 1), F.lit(size) if size is not None else F.length(b))
        return some.groupBy("id").agg(joined.alias("data")).select("id", cut(F.col("data")).alias("data"))
