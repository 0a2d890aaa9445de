"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights, and each document is emitted
``floor(rate)`` times plus once more if its hash-seeded coin, of probability equal to the
fraction of the rate, says so.

Defined results: null or empty text counts no words; a null source is a source of its own
and comes last; repeated rows toss the same coin, by their id; a source without any word
has rate 1, so its (empty) documents stay once; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, free_name, materialize, unit_hash, word_count

WEIGHTS = (1, 2, 3)
MOST = 3.0
SEED = 20240


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, size): source, source_size, target, rate; one row per source.

    Targets share the total by weight, none above ``most`` times its source's size. The shares
    that end no further resharing are ``min(weight * level, cap)`` for one level; with the
    sources sorted by cap / weight, the ones at their cap come first, and running sums give
    the level at the first source that stays below its cap. Rows here are sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(nth - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("nth", F.row_number().over(by))
    below = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    per = per.withColumn("level", F.min(below).over(whole)["level"])
    # where rounding leaves no source below its cap, all of them are at it
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _with_rates(docs: DataFrame, rates: DataFrame, source: Column) -> tuple[DataFrame, str]:
    """docs with a struct of its source's rate, and that column's name. Sources are few beside documents; their
    table is broadcast only after its rows are counted, and is else joined by key."""
    key, null, held = (free_name(docs, x) for x in ("__source", "__null", "__rate"))
    rates = materialize(rates, "rates").select(F.coalesce("source", F.lit("")).alias(key), F.col("source").isNull().alias(null), F.struct("source_size", "target", "rate").alias(held))
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    keyed = docs.withColumn(key, F.coalesce(source, F.lit(""))).withColumn(null, source.isNull())
    return keyed.join(rates, [key, null], "left").drop(key, null), held


def _copies(rate: Column, coin: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (coin < rate - whole).cast("long")).cast("long")


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = materialize(sizes, "sizes")  # the words are counted once
    full, rate = _with_rates(sizes, source_rates(sizes, weights, most), F.col("source"))
    copies = _copies(F.col(rate)["rate"], unit_hash(seed, F.col("doc_id")))
    return full.select("doc_id", "source", "size", f"{rate}.source_size", f"{rate}.target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    full, rate = _with_rates(docs, source_rates(sizes, weights, most), F.col(source))
    copies = _copies(F.col(rate)["rate"], unit_hash(seed, F.col(doc_id)))
    nth = free_name(docs, "copy")
    return full.withColumn(nth, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM per),
c AS (SELECT *, row_number() OVER o AS nth,
             ((SELECT sum(source_size) FROM per)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
lv AS (SELECT arg_min(level, nth) AS level FROM c WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(coalesce(lv.level * weight, cap), cap) AS target FROM c, lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('20240:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
