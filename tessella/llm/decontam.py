"""Benchmark decontamination: SimHash of item-sized windows. DataFrame functions only.

1. Windows. A window has the size of a benchmark item, in words. Only windows that can be similar
   at all are cut: the item and the window must have a k-word shingle in common, and the window
   starts where that shingle puts the item's start (cut at the ends of the document).
2. Fingerprints. SimHash of the window's shingles, each weighed by how often it occurs.
3. Multi-index. 64 bits in 8 blocks: fingerprints within a distance of 23 agree in some block up to two
   bits, so items are filed under all such variants of each block (37 of 256), together with their size,
   and windows look up their 8 blocks. Nothing within the radius is missed.
4. Candidates within the radius are verified: sum of least weights over sum of greatest weights,
   on the shingles themselves.

At a weighted similarity of 0.8 fingerprints differ in 9.7 bits, with a standard deviation of 2.9, so
the radius loses fewer than one in 100,000 there and none of the closer ones.

Bounds: the benchmark's shingles and variants, and the windows found, are broadcast only up to ``BROADCAST_BYTES``,
and joined by key beyond that.

Defined results: null or empty texts and items match nothing; an item of fewer than k words
has one shingle of its own length; a null item id is found and reported as null; repeated documents are each reported, repeated items by each id; of
several windows the most similar counts, then the first; empty tables give empty tables. Only id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, lower_ascii, materialize, word_array

K, PERCENT = 5, 80
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: What is broadcast has so many bytes at most, by a sum over its rows.
BROADCAST_BYTES = 64 << 20


def _maybe_broadcast(df: DataFrame, row_bytes: Column | int = 48) -> DataFrame:
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _at(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def shingles(words: Column, k: int = K) -> Column:
    """Hashes of the k-word shingles in order; of the whole sequence where it is shorter."""
    n = F.size(words)
    out = F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _at(words, i, k)))
    for short in range(1, k):
        out = out.when(n == short, F.array(_at(words, F.lit(0), short)))
    return out.otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more of the hashes have it than not."""
    zero = F.lit(0).cast("long")

    def bit(acc: Column, b: Column) -> Column:
        sums = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return acc.bitwiseOR(F.when(sums > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, bit)


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """(sum of least weights, sum of greatest weights) of two arrays of shingles, with repeats."""
    times = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(times(a, s), times(b, s)))
    return both, F.size(a) + F.size(b) - both


def _block(finger: Column, j: int) -> Column:
    return F.shiftrightunsigned(finger, 8 * j).bitwiseAND(F.lit(255).cast("long")).cast("int")


def _placed(words: Column, k: int) -> Column:
    """(p, h) of every k-word shingle, for at least k words."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.struct(i.alias("p"), _at(words, i, k).alias("h")))


def _variants(finger: Column, j: int) -> Column:
    """(j, value) of block j with up to FLIPS bits flipped."""
    return F.transform(F.array(*[F.lit(v) for v in _VARIANTS]), lambda v: F.struct(F.lit(j).alias("j"), _block(finger, j).bitwiseXOR(v).alias("value")))


_VARIANTS = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(8), n)]


class Decontamination:
    """k-word shingles, weighted similarity of ``percent`` hundredths or more."""

    def __init__(self, k: int = K, percent: int = PERCENT) -> None:
        self.k, self.percent = k, percent

    def _items(self, bench: DataFrame, text: str, item_id: str) -> DataFrame:
        words = bench.select(F.xxhash64(F.col(item_id), F.col(text).cast("string")).alias("item"), F.col(item_id).alias("item_id"), word_array(lower_ascii(F.col(text))).alias("w")).filter(F.size("w") > 0)
        items = words.dropDuplicates(["item"]).select("item", "item_id", F.size("w").alias("size"), shingles(F.col("w"), self.k).alias("sh"))
        return materialize(items.withColumn("finger", simhash(F.col("sh"))), "items")

    def pairs(self, docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", bench_text: str = "text", item_id: str = "item_id") -> DataFrame:
        """key (of the row's id and text), doc_id, item_id, start_word, n_words, similarity: one row per
        document and item that it contains."""
        items = self._items(bench, bench_text, item_id)
        filed = items.select("size", F.posexplode("sh").alias("q", "h")).distinct()
        filed = _maybe_broadcast(materialize(filed, "filed"))
        short = sorted(r[0] for r in items.select(F.least("size", F.lit(self.k)).alias("s")).distinct().collect())  # 1 to k
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        rows = rows.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("w", word_array(lower_ascii(F.col("text")))).drop("text")
        n = F.size("w")
        every = [F.when(n >= s, _placed(F.col("w"), s)).otherwise(F.array().cast("array<struct<p:int,h:bigint>>")) for s in short]
        if not every:
            every = [F.array().cast("array<struct<p:int,h:bigint>>")]
        seen = rows.select("key", n.alias("n"), F.inline(F.concat(*every) if len(every) > 1 else every[0])).join(filed, "h")
        start = F.greatest(F.col("p") - F.col("q"), F.lit(0))
        cut = seen.select("key", "size", start.alias("start"), F.least(F.col("n"), F.col("p") - F.col("q") + F.col("size")).alias("end")).distinct()
        cut = materialize(cut, "windows")
        held = rows.join(_maybe_broadcast(cut), "key")
        windows = held.select("key", "doc_id", "size", "start", "end", shingles(F.slice("w", F.col("start") + 1, F.col("end") - F.col("start")), self.k).alias("sh"))
        windows = materialize(windows.withColumn("finger", simhash(F.col("sh"))).distinct(), "fingers")
        # the multi-index: every item under its size, block and variant
        variants = F.explode(F.flatten(F.array(*[_variants(F.col("finger"), j) for j in range(BLOCKS)])))
        index = items.select("item", "size", F.col("finger").alias("item_finger"), variants.alias("v")).select("item", "size", "item_finger", "v.j", "v.value")
        asked = windows.select("key", "size", "start", "end", "finger", F.posexplode(F.array(*[_block(F.col("finger"), j) for j in range(BLOCKS)])).alias("j", "value"))
        near = asked.join(_maybe_broadcast(materialize(index, "index")), ["size", "j", "value"])
        near = near.filter(F.bit_count(F.col("finger").bitwiseXOR(F.col("item_finger"))) <= RADIUS)
        near = near.select("key", "size", "start", "end", "item").distinct()
        full = near.join(windows.drop("finger"), ["key", "size", "start", "end"]).join(_maybe_broadcast(items.select("item", "item_id", F.col("sh").alias("item_sh")), F.size("item_sh") * 8 + 48), "item")
        both, whole = similarity(F.col("sh"), F.col("item_sh"))
        full = full.withColumn("both", both).withColumn("whole", whole).filter((F.col("both") > 0) & (100 * F.col("both") >= self.percent * F.col("whole")))
        best = F.max_by(F.struct("start", "end", (F.col("both") / F.col("whole")).alias("similarity")), F.struct(F.col("both") / F.col("whole"), -F.col("start"), -F.col("end")))
        out = full.groupBy("key", "doc_id", "item_id").agg(best.alias("b"))
        return out.select("key", "doc_id", "item_id", F.col("b.start").cast("long").alias("start_word"), (F.col("b.end") - F.col("b.start")).cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))

    def decontaminate(self, docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """The rows of ``docs`` that contain no item."""
        mark = free_name(docs, "__key")
        found = materialize(self.pairs(docs, bench, text, doc_id).select(F.col("key").alias(mark)).distinct(), "leaks")
        keyed = docs.withColumn(mark, F.xxhash64(F.col(doc_id), F.col(text).cast("string")))
        return keyed.join(_maybe_broadcast(found), mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p+1:p+5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
bs AS (SELECT item_id, len(w) AS size, q, array_to_string(w[q+1:q+5], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS q FROM b WHERE len(w) >= 5)),
win AS (SELECT DISTINCT doc_id, size, greatest(p - q, 0) AS st, least(n, p - q + size) AS en FROM ds JOIN bs USING (s)),
ws AS (SELECT win.doc_id, size, st, en, s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND p >= st AND p + 5 <= en GROUP BY ALL),
wt AS (SELECT doc_id, size, st, en, sum(c) AS t FROM ws GROUP BY ALL),
i AS (SELECT item_id, size, s, count(*) AS c FROM bs GROUP BY ALL),
it AS (SELECT item_id, sum(c) AS t FROM i GROUP BY ALL),
x AS (SELECT ws.doc_id, item_id, ws.size, st, en, sum(least(ws.c, i.c)) AS m FROM ws JOIN i ON ws.s = i.s AND ws.size = i.size GROUP BY ALL),
y AS (SELECT x.*, m::DOUBLE / (wt.t + it.t - m)::DOUBLE AS similarity FROM x JOIN wt USING (doc_id, size, st, en) JOIN it USING (item_id) WHERE 100 * m >= 80 * (wt.t + it.t - m))
SELECT doc_id, item_id, st::BIGINT AS start_word, (en - st)::BIGINT AS n_words, similarity FROM y
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st, en) = 1
"""


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return Decontamination().pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
