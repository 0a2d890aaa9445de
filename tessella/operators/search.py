"""Search over tables: BM25, completions, synonyms, token analysis, places nearby."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import fulltext as X
from tessella.functions.base import DOUBLE, rowwise

EARTH_M = 6_371_000.0
#: Fixed values of the simple model: documents in all, documents that match, mean length.
DOCS, MATCHING, MEAN_LENGTH = 1000, 10, 256.0


def _bm25(vector: str, query: str, k1: float, b: float) -> float:
    v = X.read(vector)
    size = sum(max(len(p), 1) for p in v.values())
    idf = max(0.0, math.log((DOCS - MATCHING + 0.5) / (MATCHING + 0.5)))
    score = 0.0
    for leaf in X._leaves(X.parse_query(query, None)):
        if leaf[1] in v:
            tf = float(max(len(v[leaf[1]]), 1))
            score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / MEAN_LENGTH))
    return score


def bm25(vector: Column, query, k1: float = 1.2, b: float = 0.75) -> Column:
    """With constant statistics of the corpus; operators of the query count for nothing."""
    return rowwise(lambda v, q: _bm25(v, q, k1, b), DOUBLE)(vector, query)


def rank_bm25(docs: DataFrame, key: str, text: str, words: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the k best documents for lower-case words, with statistics of the corpus itself: one pass over texts
    gives lengths and counts, in which documents without any of the words are not listed."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = docs.select(F.col(key), tokens.alias("t")).select(key, F.size("t").alias("n"), *[F.size(F.filter("t", lambda x: x == F.lit(words[i]))).alias(f"w{i}") for i, w in enumerate(words)])
    s = base.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"w{i}"), F.col(f"d{i}")
        hit = hit | (tf > 0)
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))).otherwise(0.0)
    return base.filter(hit).crossJoin(F.broadcast(s)).select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def autocomplete(df: DataFrame, column: str, prefix: str, limit: int = 10) -> DataFrame:
    """suggestion, score: texts with a word that begins so, the best ranked first."""
    v = X.to_tsvector(F.col(column))
    q = X.show_query(X.parse_query(f"{prefix}:*"))
    # a plain filter on words comes first, so that few texts are parsed
    near = df.filter(F.exists(F.split(F.lower(F.col(column)), r"\W+"), lambda w: w.startswith(prefix[: max(1, len(prefix) - 2)].lower())))
    out = near.select(F.col(column).alias("suggestion"), v.alias("v")).filter(X.matches(F.col("v"), F.lit(q)))
    return out.select("suggestion", X.ts_rank(F.col("v"), F.lit(q)).alias("score")).orderBy(F.col("score").desc(), "suggestion").limit(limit)


def expand_synonyms(terms: DataFrame, term: str, synonyms: DataFrame) -> DataFrame:
    """A row for each term and each of its synonyms (synonyms: term, synonym), itself first."""
    pairs = synonyms.select(F.lower(F.col("term")).alias("__t"), F.lower("synonym").alias("word"))
    more = terms.join(pairs, F.lower(F.col(term)) == F.col("__t")).select(term, "word")
    return terms.select(term, F.lower(F.col(term)).alias("word")).unionByName(more).distinct()


def analyze(s: Column) -> Column:
    """Array of (token, type, position): ``inline`` it."""
    return F.transform(X.ts_parse(s, blanks=False), lambda t: F.struct(t["token"].alias("token"), t["type"].alias("type"), t["position"].alias("position")))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Meters between two places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * EARTH_M)


def nearby(df: DataFrame, lat: float, lon: float, radius: float, lat_column: str = "lat", lon_column: str = "lon", key: str = "id", limit: int = 100) -> DataFrame:
    """key and distance of the places within a radius, the nearest first. A band of latitudes, which a scan
    can skip files by, comes before the distance."""
    d = haversine(F.lit(lat), F.lit(lon), F.col(lat_column), F.col(lon_column))
    band = math.degrees(radius / EARTH_M) + 1e-9
    return df.filter(F.col(lat_column).between(lat - band, lat + band)).select(key, d.alias("distance")).filter(F.col("distance") <= radius).orderBy("distance", key).limit(limit)
