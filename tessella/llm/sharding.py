"""Sharding by extendible hashing.

A document's address is the first 32 bits of the md5 of its id. The directory begins with one
bucket; a bucket of more than ``limit`` bytes splits on the next bit, others stay, until each
fits. Bytes are those of the text in UTF-8.

Defined results: null text has 0 bytes, a null id the address of the empty string; repeated rows share an address,
so a bucket of nothing but copies of one id, or of one text above the limit, ends at 32 bits
and is marked ``oversize``; an empty table gives an empty table. Columns of the input stay;
the new ones get underscores behind their names where those are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, materialize, split_join

LIMIT = 16 * 1024 * 1024
#: The registered query's: shards of a megabyte, as one request to an object store fetches, so that small inputs split too.
QUERY_LIMIT = 1024 * 1024
BITS = 32
#: The directory has a row for each prefix of so many bits less than an even split would need,
COARSE = 2
#: and the first pass counts so many levels below that; deeper buckets take a second pass.
SLACK = 6
#: The directory is broadcast up to so many bytes, at about LEAF_BYTES for each of its leaves.
BROADCAST_BYTES, LEAF_BYTES = 64 << 20, 64


def address(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _prefix(addr: Column, depth: Column) -> Column:
    return F.floor(addr / F.pow(F.lit(2.0), F.lit(BITS) - depth)).cast("long")


def _tree(cells: DataFrame, width: int, first: int, last: int) -> DataFrame:
    """From (cell, docs, bytes), a cell being a prefix of ``width`` bits: docs and bytes of every
    bucket of ``first`` to ``last`` bits that holds something."""
    at = cells.select("cell", "docs", "bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
    prefix = F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(width) - F.col("depth"))).cast("long")
    return at.withColumn("prefix", prefix).groupBy("depth", "prefix").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))


def _leaves(tree: DataFrame, limit: int, first: int) -> DataFrame:
    """Buckets that end the splitting: they fit (or have no bit left), and their parent doesn't."""
    up = tree.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("up_bytes"))
    here = tree.withColumn("up", F.floor(F.col("prefix") / 2).cast("long"))
    joined = here.join(up, ["depth", "up"], "left")
    ends = (F.col("bytes") <= limit) | (F.col("depth") == BITS)
    born = (F.col("depth") == first) | (F.col("up_bytes") > limit)
    return joined.filter(ends & born).select("depth", "prefix", "docs", "bytes")


def leaves_of(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """(leaves, base). A leaf: depth, prefix, docs, bytes. ``base``: the bits of a row of the directory, from
    the bytes of all texts. Counting begins at cells of SLACK more bits, summed where texts are read; levels
    above ``base`` are sums of those below. Only rows of cells that are still too large take a second pass."""
    rows = materialize(docs.select(address(F.col(doc_id)).alias("addr"), n_bytes(F.col(text)).alias("bytes")), "addresses")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base = max(0, min(BITS - SLACK, int(math.log2(max(1.0, total / limit))) - COARSE))
    last = base + SLACK
    cell = _prefix(F.col("addr"), F.lit(last))
    cells = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))
    low = materialize(_tree(cells, last, base, last), "buckets")
    tree = low
    if base:
        tops = low.filter(F.col("depth") == base).select(F.col("prefix").alias("cell"), "docs", "bytes")
        tree = low.unionByName(_tree(tops, base, 0, base - 1))
    leaves = _leaves(tree, limit, 0)
    large = low.filter((F.col("depth") == last) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
    if last < BITS and large.limit(1).count():
        deep = split_join(rows.withColumn("cell", cell), large, "cell", "left_semi").select(F.col("addr").alias("cell"), F.lit(1).alias("docs"), "bytes")
        leaves = leaves.unionByName(_leaves(_tree(deep, BITS, last, BITS), limit, last).filter(F.col("depth") > last))
    return materialize(leaves, "leaves"), base


def directory(leaves: DataFrame, base: int) -> DataFrame:
    """(cell, leaves): for every prefix of ``base`` bits the leaves below it, or the one above it, with the addresses
    that each holds. A cell has a few leaves, as it holds a few times the limit; a single large text adds one per level."""
    wide = F.pow(F.lit(2.0), F.lit(BITS) - F.col("depth")).cast("long")
    at = leaves.select(F.struct((F.col("prefix") * wide).alias("start"), ((F.col("prefix") + 1) * wide).alias("end"), "depth", "prefix", "docs", "bytes").alias("leaf"))
    size = 1 << (BITS - base)
    first, last = F.floor(F.col("leaf.start") / size), F.floor((F.col("leaf.end") - 1) / size)
    cells = at.select(F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("cell"), "leaf")
    return cells.groupBy("cell").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))


def assign(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_bytes, shard (the bits of its bucket as text), depth, shard_bytes,
    shard_docs and oversize. The rows meet the directory by their cell, at every size by the same join; the directory's
    bytes decide whether it is broadcast."""
    leaves, base = leaves_of(docs, limit, text, doc_id)
    cell, found = free_name(docs, "__cell"), free_name(docs, "__leaves")
    table = materialize(directory(leaves, base), "directory")
    size = table.agg(F.sum(F.size("leaves"))).first()[0] or 0
    table = table.withColumnsRenamed({"cell": cell, "leaves": found})
    addr = address(F.col(doc_id))
    keyed = docs.withColumn(cell, _prefix(addr, F.lit(base)))
    out = keyed.join(F.broadcast(table), cell) if size * LEAF_BYTES <= BROADCAST_BYTES else split_join(keyed, table, cell)
    leaf = F.get(F.filter(F.col(found), lambda x: (x["start"] <= addr) & (addr < x["end"])), F.lit(0))
    bits = F.when(leaf["depth"] == 0, F.lit("")).otherwise(F.lpad(F.bin(leaf["prefix"]), leaf["depth"], F.lit("0")))
    new = {"n_bytes": n_bytes(F.col(text)), "shard": bits, "depth": leaf["depth"], "shard_bytes": leaf["bytes"], "shard_docs": leaf["docs"], "oversize": leaf["bytes"] > limit}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(free_name(docs, k)) for k, v in new.items()])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> None:
    """One folder per shard; a shard fits one task, as its bytes are bounded."""
    out = assign(docs, limit, text, doc_id)
    shard = free_name(docs, "shard")
    out.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)


ORACLE = """
WITH a AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS addr FROM documents),
s AS (SELECT d::INT AS depth, (addr >> (32 - d))::BIGINT AS prefix, count(*) AS docs, sum(n_bytes)::BIGINT AS bytes FROM a, range(0, 33) AS r(d) GROUP BY 1, 2),
leaf AS (SELECT s.* FROM s LEFT JOIN s AS up ON up.depth = s.depth - 1 AND up.prefix = s.prefix >> 1
         WHERE (s.bytes <= 1048576 OR s.depth = 32) AND (s.depth = 0 OR up.bytes > 1048576))
SELECT a.doc_id, a.n_bytes, CASE WHEN depth = 0 THEN '' ELSE to_base(prefix, 2, depth) END AS shard, depth, bytes AS shard_bytes, docs AS shard_docs
FROM a JOIN leaf ON leaf.prefix = a.addr >> (32 - depth)
"""


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, QUERY_LIMIT).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
