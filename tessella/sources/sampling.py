"""TABLESAMPLE. Draws are hashes of a seed and the row (or its file and block), so that a seed names one sample however rows are dealt and
whatever is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _free(df: DataFrame, name: str) -> str:
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bernoulli(df: DataFrame, percent: float, seed: int, *key: str) -> DataFrame:
    """Each row with a chance of ``percent`` hundredths. ``key``: columns that name a row, by default all of them; rows
    that are equal in these share a draw."""
    if not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (key or df.columns)]), F.lit(1 << 40))
    return df.filter(draw < round(percent / 100 * (1 << 40)))


def system(df: DataFrame, percent: float, seed: int, block_bytes: int = 1 << 27) -> DataFrame:
    """Whole blocks of files (of up to ``block_bytes``) with a chance of ``percent`` hundredths each: neighbours come together. For tables
    read from files."""
    if not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    block = F.struct(F.col("_metadata.file_path"), F.floor(F.col("_metadata.file_block_start") / block_bytes))
    draw = F.pmod(F.xxhash64(F.lit(seed), block), F.lit(1 << 40))
    return df.filter(draw < round(percent / 100 * (1 << 40)))


def system_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, or all if there are fewer: those with the least draws."""
    draw = _free(df, "__draw")
    keys = [F.col(f"`{c}`") for c in (key or df.columns)]
    return df.withColumn(draw, F.xxhash64(F.lit(seed), *keys)).orderBy(draw, *keys).limit(n).drop(draw)


def system_time(df: DataFrame, milliseconds: float, seed: int) -> DataFrame:
    """About the rows that can be read within a time: a part of them is read to find the rate, then that share is sampled."""
    import time

    probe = bernoulli(df, 1.0, seed)
    start = time.monotonic()
    probe.write.format("noop").mode("overwrite").save()
    took = max((time.monotonic() - start) * 1000, 1e-3)
    return bernoulli(df, min(100.0, 100.0 * milliseconds / took), seed)
