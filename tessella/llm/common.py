"""Scratch tables, words and joins that the pipeline operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The most rows a table may have to be broadcast; each use names what it counts.
BROADCAST_ROWS = 50_000

_made: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a local folder is set where the session names none; on a cluster
    executors would not see each other's files in it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            root = held
        elif not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = tempfile.mkdtemp(prefix="tessella-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that
    outlive any executor. The tables go when the driver's Python ends."""
    spark = df.sparkSession
    base = f"{scratch_root(spark)}/tessella-{spark.sparkContext.applicationId}"
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if base not in _made:
        _made.add(base)
        atexit.register(_drop, spark, base)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more, so that it takes no disk beside what follows."""
    files = df.inputFiles()
    if files:
        _drop(df.sparkSession, df.sparkSession.sparkContext._jvm.java.net.URI(files[0].rsplit("/", 1)[0]))


def _drop(spark: SparkSession, base) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to sweep
        pass


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words of a text, null counting as empty: ``array<string>``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from an md5 of the seed and the columns (null as empty): 52 bits,
    so that any engine with md5 computes the same double."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a long key of which some values may be hot on the left.

    The key is flipped bit by bit on both sides, so that both are exchanged for this join
    alone and adaptive execution may cut the partitions of a hot key into pieces. Only the flipped
    key travels; the key itself comes back behind the other columns.
    """
    k = free_name(left, "__flipped")
    a = left.withColumn(k, F.bitwise_not(F.col(key))).drop(key)
    b = right.withColumn(k, F.bitwise_not(F.col(key))).drop(key)
    return a.join(b, k, how).withColumn(key, F.bitwise_not(F.col(k))).drop(k)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if the table has such a column already."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
