"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Each text is scanned for candidates of four kinds. Three are reported always: ``assign``
(a keyword, a sign, a value), ``access`` (key ids with a fixed head) and ``hex`` (long
hexadecimal runs). The fourth, ``opaque`` (long runs of letters of both cases and digits), is
reported only where the corpus speaks for it: the hashes of all candidates are counted by
distinct repositories and owners, and an opaque string that ``shared_owners`` owners or more
carry is a copied example, while one that few carry looks live. All spans get that class.

Positions come from splitting the text at the matches: a match starts where the pieces and
matches before it end, in code points. Their lengths are summed by a window over the matches, not the text, which
stays where it was read.

Defined results: null or empty text has no spans; a null repository counts as one of its own;
repeated rows are scanned each and add nothing to the distinct counts; an empty table gives an
empty table. Every row is kept. Only id, repository and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, split_join

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run is found whole, so the least lengths can stand in these patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9_+/-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
BASE = 3
SHARED_OWNERS = 3


def _found(text: Column, pattern: str, kind: int, hint: Column | None = None, keep=None) -> Column:
    """Matches of one pattern: array of (kind, gap, length, key, keep), gap being the characters since the match before.
    ``keep``: which matches count."""
    none = F.array().cast("array<struct<kind:int,gap:long,length:long,key:long,keep:boolean>>")
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(piece: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern, 1) if kind == 0 else match
        return F.struct(F.lit(kind).alias("kind"), F.length(piece).cast("long").alias("gap"), F.length(match).cast("long").alias("length"), F.xxhash64(value).alias("key"), keep(match).alias("keep"))

    zipped = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(matches), F.lit(0))), matches, one)
    return F.when(text.rlike(pattern) if hint is None else hint & text.rlike(pattern), zipped).otherwise(none)


def matches_of(text: Column) -> Column:
    """All matches of a text, in order within each kind."""
    t = F.coalesce(text, F.lit(""))
    yes = lambda m: F.lit(True)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_LEAST
    return F.concat(_found(t, ASSIGN, 0, keep=long_value), _found(t, ACCESS, 1, t.contains("AKIA"), yes), _found(t, HEX, 2, keep=yes), _found(t, OPAQUE, 3, keep=mixed))


def placed(matches: DataFrame) -> DataFrame:
    """From (row, ..., found) one row per match that counts, with its start and end: running sums along
    a text, so that the work grows with the number of its matches and no more."""
    each = matches.filter(F.size("found") > 0).select("row", "repo", "owner", F.posexplode("found").alias("pos", "m")).select("row", "repo", "owner", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("pos"))
    return each.withColumn("end", end).filter("keep").select("row", "repo", "owner", (F.col("end") - F.col("length")).alias("start"), "end", "kind", "key")


def ownership(candidates: DataFrame) -> DataFrame:
    """(key, repo, owner) to key, n_repos, n_owners: distinct counts over the whole corpus.
    Copies within a repository fall together before anything is dealt by key."""
    pairs = candidates.select("key", F.coalesce("repo", F.lit("\u0000")).alias("repo"), F.coalesce("owner", F.lit("\u0000")).alias("owner")).distinct()
    owners = pairs.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n"))
    # an owner has whole repositories, so its counts of them add up
    return owners.groupBy("key").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, text: str = "text", repo: str = "source", owner: Column | None = None, doc_id: str = "doc_id", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """Per row: doc_id and spans, an array of (start, end, kind, n_repos, n_owners, class), by
    start, then kind. ``owner``: by default the part of the repository's name before a slash."""
    who = F.substring_index(F.col(repo).cast("string"), "/", 1) if owner is None else owner
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(repo).cast("string").alias("repo"), who.alias("owner"), matches_of(F.col(text)).alias("found"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    one = materialize(placed(rows), "matches")
    stats = ownership(one)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    live = F.col("n_owners") < shared_owners
    judged = split_join(one, stats, "key").filter((F.col("kind") < BASE) | live)
    span = F.struct("start", F.col("kind").alias("kind_no"), "end", kind.alias("kind"), "n_repos", "n_owners", F.when(live, "live").otherwise("example").alias("class"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The counts and texts of ``scan``'s spans."""
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["class"] == "live")).cast("long").alias("n_live"),
    )


def _sql_kind(n: int, pattern: str, value: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, source, {n} AS kind, starts AS st, starts + length(m) AS en, {value} AS val FROM (
      SELECT rid, source, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::BIGINT AS starts
      FROM (SELECT rid, source, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms FROM d)) WHERE {keep}"""


_A = ASSIGN.replace("'", "''")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({_sql_kind(0, ASSIGN, f"regexp_extract(m, '{_A}', 1)", f"length(regexp_extract(m, '{_A}', 1)) >= 6")}
 UNION ALL {_sql_kind(1, ACCESS, "m", "true")} UNION ALL {_sql_kind(2, HEX, "m", "true")}
 UNION ALL {_sql_kind(3, OPAQUE, "m", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")}),
o AS (SELECT val, count(DISTINCT coalesce(split_part(source, '/', 1), chr(1))) AS owners FROM c GROUP BY val),
s AS (SELECT c.*, owners < 3 AS live, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || st || ':' || en AS txt FROM c JOIN o USING (val) WHERE kind < 3 OR owners < 3),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_opaque,
  string_agg(txt, ',' ORDER BY st, kind) FILTER (kind < 3) AS base, string_agg(txt, ',' ORDER BY st, kind) AS spans, count(*) FILTER (live) AS n_live FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_opaque, 0) AS n_opaque,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN g USING (rid)
"""


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return digest(scan(table(spark, sf_dir, "documents")))
