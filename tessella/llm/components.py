"""Connected components of a table of links, by min-label rounds with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, split_join

#: Labels are broadcast up to this count (16 bytes each), and joined by key beyond it.
BROADCAST_LABELS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (v, c): for each vertex of a link the smallest vertex that it reaches.

    A round takes the least label of the neighbours and then the label of that label, so long
    chains shorten by steps that double. Rounds end at written tables; only a count of
    changes comes to the driver. A vertex with very many links has its join cut in pieces,
    and least labels are found before rows are dealt by vertex.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = materialize(both.filter("src <> dst").distinct(), "links")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("v"), F.least("src", "m").alias("c")), "labels")
    if labels.count() <= BROADCAST_LABELS:
        look = lambda left, key, how: left.join(F.broadcast(labels.withColumnRenamed("v", key)), key, how)
    else:
        look = lambda left, key, how: split_join(left, labels.withColumnRenamed("v", key), key, how)
    while True:
        near = look(both, "src", "inner").groupBy("dst").agg(F.min("c").alias("m"))
        # every vertex is the end of a link, so that near has them all
        step = look(near.withColumnRenamed("dst", "v"), "v", "inner").select("v", F.col("c").alias("old"), F.least("c", "m").alias("k"))
        jump = look(step, "k", "left")
        new = materialize(jump.select("v", F.least("k", "c").alias("c"), (F.least("k", "c") < F.col("old")).alias("changed")), "labels")
        labels = new.select("v", "c")
        if not new.filter("changed").limit(1).count():
            return labels
