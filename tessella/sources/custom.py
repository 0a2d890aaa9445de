"""Sources of one's own: series of numbers read in parts, with filters pushed down, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader


class Part(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SeriesReader(DataSourceReader):
    def __init__(self, low: int, high: int, step: int, parts: int) -> None:
        self.low, self.high, self.step, self.parts = low, high, step, parts

    def pushFilters(self, filters):
        """Bounds of ``id`` narrow the series; other filters are left to the engine."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("id",):
                v = f.value
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low += max(0, -(-(v - self.low) // self.step)) * self.step
                if isinstance(f, GreaterThan):
                    self.low += max(0, (v - self.low) // self.step + 1) * self.step
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, v)
                if isinstance(f, LessThan):
                    self.high = min(self.high, v - 1)
                if isinstance(f, EqualTo):
                    yield f
            else:
                yield f

    def partitions(self):
        n = max(0, (self.high - self.low) // self.step + 1)
        size = -(-n // self.parts) or 1
        return [Part(self.low + i * self.step, min(self.high, self.low + (i + size - 1) * self.step)) for i in range(0, n, size)] or [Part(1, 0)]

    def read(self, partition):
        for x in range(partition.low, partition.high + 1, self.step):
            yield (x,)


class SeriesStream(SimpleDataSourceStreamReader):
    def __init__(self, low: int, high: int, step: int, rows: int) -> None:
        self.low, self.high, self.step, self.rows = low, high, step, rows

    def initialOffset(self):
        return {"next": self.low}

    def read(self, start):
        values = range(start["next"], min(self.high, start["next"] + (self.rows - 1) * self.step) + 1, self.step)
        end = {"next": values[-1] + self.step} if len(values) else start
        return iter([(x,) for x in values]), end

    def readBetweenOffsets(self, start, end):
        return iter([(x,) for x in range(start["next"], end["next"], self.step)])

    def commit(self, end):
        pass


class SeriesSource(DataSource):
    """generate_series(start, stop, step), both ends included."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "id long"

    def _numbers(self) -> tuple[int, int, int]:
        return int(self.options.get("start", 1)), int(self.options["stop"]), int(self.options.get("step", 1))

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(*self._numbers(), int(self.options.get("parts", 4)))

    def simpleStreamReader(self, schema):
        return SeriesStream(*self._numbers(), int(self.options.get("rows", 1000)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)
