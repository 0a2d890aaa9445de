"""Nearest neighbours: exact, and by inverted lists of centroids. Matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.vectors import DISTANCES
from tessella.operators.joins import nearest_join

#: The centroids are fitted on so many vectors, chosen by hash; every vector is indexed.
SAMPLE, LISTS, ROUNDS = 10_000, 100, 20
#: Queries of one pass over the rows, queries of one matrix product, pairs whose distances are summed at once.
BLOCK, TILE, PAIRS = 10_000, 512, 1 << 20


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "l2", vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector, exactly: each task keeps k, and these are merged."""
    q = F.lit([float(x) for x in query])
    return rows.withColumn("distance", DISTANCES[metric](F.col(vector), q)).orderBy("distance", tie).limit(k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vector: str = "embedding", tie: str = "vec_id", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The k rows nearest to each query, exactly; null distances come last. For l2 the driver holds the queries and sends them
    out by blocks; rows are compared by matrix products, and those that may be among the k once more by the defined sum."""
    if metric != "l2":
        return nearest_join(queries.select(query, query_vector), rows.select(tie, vector), DISTANCES[metric](F.col(vector), F.col(query_vector)), query, tie, k).select(query, tie, "distance", "rank")
    # few files would be few tasks
    dealt = rows.select(tie, vector).repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    return _ranked(dealt, queries.select(query, query_vector), k, lambda run, x, usable, ids, part, q, known: _best(x, usable, ids, q, known, k, run))


def _ranked(rows: DataFrame, queries: DataFrame, k: int, best) -> DataFrame:
    """rows: key, vector, and maybe more. queries: key, vector. ``best(run, matrix, usable, order of keys, batch, queries, usable queries)``
    gives positions of rows and queries, and distances; what it gives is ranked."""
    spark, key, query = rows.sparkSession, rows.columns[0], queries.columns[0]
    schema = T.StructType([queries.schema[0], rows.schema[0], T.StructField("distance", T.DoubleType())])
    asked, out = queries.toArrow().combine_chunks(), None
    for start in range(0, max(1, asked.num_rows), BLOCK):
        sent = spark.sparkContext.broadcast(asked.slice(start, BLOCK).combine_chunks())

        def run(batches, sent=sent):
            t = sent.value
            names, vectors = (t.column(i).combine_chunks() if t.num_rows else None for i in (0, 1))
            if not t.num_rows:
                return
            lengths = pc.list_value_length(vectors).drop_null()
            dims = lengths[0].as_py() if len(lengths) else 0
            q, known = _matrix(vectors, dims)
            least = np.full(len(q), np.inf)  # the k-th distance so far
            for b in batches:
                if not b.num_rows:
                    continue
                x, usable = _matrix(b.column(1), dims if len(lengths) else None)
                ids = np.empty(b.num_rows, np.int64)
                ids[pc.sort_indices(b.column(0)).to_numpy()] = np.arange(b.num_rows)
                for i, j, d in [*best(least, x, usable, ids, b, q, known), *_unknown(ids, usable, known, k)]:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), b.column(0).take(pa.array(i)), d], names=schema.names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy(query).orderBy(F.asc_nulls_last("distance"), F.col(key))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(col: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, and which of them have no null."""
    lengths, known = pc.list_value_length(col), col.is_valid().to_numpy(zero_copy_only=False)
    if dims is None:
        dims = 0
    elif pc.any(pc.not_equal(lengths, dims)).as_py():
        raise ValueError("different vector dimensions")
    x, usable = np.zeros((len(col), dims)), known.copy()
    if dims and known.any():
        flat = pc.list_flatten(col)
        usable[known] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(1)
        x[known] = np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(-1, dims)
    x[~usable] = 0
    return x, usable


def _unknown(ids: np.ndarray, usable: np.ndarray, known: np.ndarray, k: int):
    """Pairs of null distance: the first k rows for a query without a vector, rows without one for the other queries."""
    for left, right in ((np.arange(len(ids)), np.flatnonzero(~known)), (np.flatnonzero(~usable), np.flatnonzero(known))):
        first = left[np.argsort(ids[left])[:k]]
        if len(first) and len(right):
            n = len(first) * len(right)
            yield np.tile(first, len(right)), np.repeat(right, len(first)), pa.nulls(n, pa.float64())


def _best(x: np.ndarray, usable: np.ndarray, ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int, least: np.ndarray):
    """The k rows of ``x`` nearest to each query, unless k nearer ones were seen before; ``least`` is kept up."""
    at = np.flatnonzero(usable)
    if not len(at):
        return
    x, xx = x[at], (x[at] * x[at]).sum(1)
    for some in np.array_split(np.flatnonzero(known), max(1, -(-int(known.sum()) // TILE))):
        y = q[some]
        yy = (y * y).sum(1)
        near = yy[:, None] + xx[None, :] - 2 * (y @ x.T)
        # by how much the product and the sum may differ; values that aren't finite are compared by the sum
        slack = 1e-14 * (x.shape[1] + 8) * (yy + xx.max())
        odd = ~np.isfinite(near)
        near[odd] = np.inf
        kth = np.partition(near, k - 1, axis=1)[:, k - 1] if k < near.shape[1] else np.full(len(y), np.inf)
        near[odd] = -np.inf
        most = np.minimum(kth, least[some] ** 2) + 2 * slack
        most[np.isnan(most)] = np.inf
        j, i = np.nonzero(near <= most[:, None])
        d = np.empty(len(i))
        for s in range(0, len(i), PAIRS):
            a, b, total = i[s : s + PAIRS], j[s : s + PAIRS], 0.0
            for n in range(x.shape[1]):  # in the order of the elements, as the sum is defined
                z = x[a, n] - y[b, n]
                total = total + z * z
            d[s : s + PAIRS] = np.sqrt(total)
        order = np.lexsort((ids[at[i]], d, j))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        last = place == k - 1
        least[some[j[last]]] = np.fmin(least[some[j[last]]], d[last])
        keep = place < k
        if keep.any():
            yield at[i[keep]], some[j[keep]], pa.array(d[keep])


class InvertedLists:
    """Every vector is filed under its nearest centroid; a query looks at the lists of its nearest centroids and ranks
    their vectors exactly. ``write`` makes one folder a list, so that a query reads its lists alone."""

    def __init__(self, rows: DataFrame, vector: str = "embedding", key: str = "vec_id", lists: int = LISTS, sample: int = SAMPLE, seed: int = 1) -> None:
        self.vector, self.key = vector, key
        h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
        part = min(1.0, 1.2 * sample / max(1, rows.count()))
        got = rows.filter(F.col(vector).isNotNull() & (h < int(part * (1 << 30)))).select(h.alias("h"), vector).orderBy("h").limit(sample).collect()  # bounded
        x = np.array([r[1] for r in got], float)
        self.centroids = _k_means(x, min(lists, max(1, len(x))), seed) if len(x) else np.zeros((0, 0))

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their list."""
        c, at = self.centroids, rows.columns.index(self.vector)
        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

        def run(batches):
            for b in batches:
                x, _ = _matrix(b.column(at), c.shape[1])
                near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[f.name for f in schema.fields])

        return rows.mapInArrow(run, schema)

    def write(self, rows: DataFrame, path: str) -> None:
        self.assign(rows).write.partitionBy("list").parquet(path)

    def search(self, index: DataFrame, queries: DataFrame, k: int, probes: int | None = None, query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """``index``: what ``assign`` gives, or what ``write`` wrote. Without ``probes`` the result is exact: a query leaves out
        only lists whose vectors are all farther, by their centroid and radius, than k that it has. With it, it looks at the lists
        of so many nearest centroids."""
        c = self.centroids

        def best(least, x, usable, ids, b, q, known):
            far = np.stack([np.sqrt(((q - at) ** 2).sum(1)) for at in c], 1)
            filed = np.asarray(b.column(2).to_numpy(zero_copy_only=False))
            order = far.argsort(1)
            for own in (True, False):  # the nearest list first
                for n in np.unique(filed):
                    here = filed == n
                    ask = known & ((order[:, 0] == n) == own)
                    if probes is not None:
                        ask &= (order[:, :probes] == n).any(1)
                    else:
                        radius = np.sqrt(((x[here & usable] - c[n]) ** 2).sum(1)).max() if (here & usable).any() else 0.0
                        ask &= ~(far[:, n] - radius > least + 1e-6 * (1 + far[:, n] + radius))
                    if ask.any():
                        yield from _best(x, usable & here, ids, q, ask, k, least)

        return _ranked(index.select(self.key, self.vector, "list"), queries.select(query, query_vector), k, best)


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", key: str = "vec_id") -> float:
    """The part of the exact neighbours that was found."""
    n = exact.count()
    return found.select(query, key).join(exact.select(query, key), [query, key], "left_semi").count() / n if n else 1.0


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) times (j, k, v) as (i, k, v): a join on the inner index and sums."""
    x, y = a.select("i", "j", F.col("v").alias("x")), b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y"))
    return x.join(y, "j").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("v")).select("i", F.col("k").alias("j"), "v")
