"""Full-text search, ranking, fuzzy and phonetic matching, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import fulltext as X
from tessella.functions import phonetic as P
from tessella.operators import search as S
from tessella.plans.registry import cases, expect, query
from tessella.session import table

c, f = F.col, F.lit
FOX = "The Fat Rats ate the fat cats"


@cases("fts_vectors", f"SELECT '{FOX}' AS s", expect("v, simple, arr, len, st, w, wl, cat, d, fl, lex, toarr, plain", ("'ate':4 'cat':7 'fat':2,6 'rat':3", "'ate':4 'cats':7 'fat':2,6 'rats':3 'the':1,5", "'a' 'b'", 4, "'ate' 'cat' 'fat' 'rat'", "'cat':3A 'fat':2A,4A", "'cat':3A 'fat':2,4", "'a':1 'b':2 'c':3", "'ate':4 'cat':7 'rat':3", "'a':1A 'c':3B", ["star"], ["ate", "cat", "fat", "rat"], "'a':1 'b c'")))
def _():
    v = X.to_tsvector(c("s"))
    return {
        "v": v, "simple": X.to_tsvector(c("s"), "simple"), "arr": X.array_to_tsvector(F.array(f("b"), f("a"))), "len": X.length(v), "st": X.strip(v), "w": X.setweight(f("fat:2,4 cat:3"), "A"), "wl": X.setweight(f("fat:2,4 cat:3"), "A", ["cat"]),
        "cat": X.concat(f("a:1 b:2"), f("c:1")), "d": X.ts_delete(v, "fat"), "fl": X.ts_filter(f("a:1A b:2 c:3B"), F.array(f("a"), f("b"))), "lex": X.ts_lexize(f("stars")), "toarr": X.tsvector_to_array(v), "plain": X.tsvector(f("'b c' a:1")),
    }


@cases(
    "fts_queries",
    "SELECT 1",
    expect(
        "t, p, ph, w1, w2, w3, n, qt, rw, pp, an, orr, no, ct, sk",
        ("'fat' & 'rat'", "'fat' & 'rat'", "'cat' <2> 'rat'", "'supernova' <-> 'star' & !'crab'", "'sad' <-> 'cat' | 'fat' <-> 'rat'", "'signal' & !( 'segment' <-> 'fault' )", 5, "'foo'", "'b' & 'foo'", "'fat' <10> 'cat'", "'fat' & 'rat' & 'cat'", "'fat' | 'cat'", "!'cat'", True, "'fat' & ( 'rat' | !'cat' )"),
    ),
)
def _():
    return {
        "t": X.to_tsquery(f("The & Fat & Rats")), "p": X.plainto_tsquery(f("The Fat Rats")), "ph": X.phraseto_tsquery(f("The Cat and Rats")), "w1": X.websearch_to_tsquery(f('"supernovae stars" -crab')), "w2": X.websearch_to_tsquery(f('"sad cat" or "fat rat"')),
        "w3": X.websearch_to_tsquery(f('signal -"segmentation fault"')), "n": X.numnode(f("(fat & rat) | cat")), "qt": X.querytree(f("foo & ! bar")), "rw": X.ts_rewrite(f("a & b"), f("a"), f("foo")),
        "pp": X.tsquery_phrase(X.to_tsquery(f("fat")), X.to_tsquery(f("cat")), 10), "an": X.q_and(f("fat & rat"), f("cat")), "orr": X.q_or(f("fat"), f("cat")), "no": X.q_not(f("cat")), "ct": X.q_contains(f("cat & rat"), f("cat")), "sk": X.tsquery(f("fat & (rat | !cat)")),
    }


@cases("fts_match", "SELECT 1", expect("a, b, d, e, g, h, i, j", (True, False, True, False, True, True, False, True)))
def _():
    v = X.to_tsvector(f("fatal error: the fat cats sat"))
    m = lambda q: X.matches(v, X.to_tsquery(f(q)))
    return {"a": m("fat & cat"), "b": m("fat & dog"), "d": m("fatal <-> error"), "e": m("error <-> fat"), "g": m("super:* | fat:*"), "h": m("!dog"), "i": X.matches(f("cat:3"), f("cat:A")), "j": X.matches(f("cat:3A"), f("cat:AB"))}


@cases("fts_rank", "SELECT 1", expect("a, b, d, e, g, n", (0.060793, 0.099103, 0.1, 0.05, 0.607927, 0.038356)))
def _():
    r = lambda x: F.round(x, 6)
    return {"a": r(X.ts_rank(f("cat:1"), f("cat"))), "b": r(X.ts_rank(f("a:1 b:2"), f("a & b"))), "d": r(X.ts_rank_cd(f("a:1 b:2"), f("a & b"))), "e": r(X.ts_rank_cd(f("a:1 x:2 b:3"), f("a & b"))), "g": r(X.ts_rank(f("cat:1A"), f("cat"))), "n": r(X.ts_rank(f("cat:1 dog:2"), f("cat"), normalization=1))}


@cases("fts_headline", "SELECT 'The most common type of search is to find all documents containing given query terms' AS s", expect("a, b, t", ("The most common type of <b>search</b> is to find all documents containing given <b>query</b> terms", "[search] is to find all documents containing given [query]", "asciiword:foo blank:  int:42")))
def _():
    q = X.to_tsquery(f("query & search"))
    return {"a": X.ts_headline(c("s"), q), "b": X.ts_headline(c("s"), q, start="[", stop="]", max_words=9, min_words=5), "t": _types("foo 42")}


def _types(text):
    from tessella.functions.base import STRING, rowwise

    return rowwise(lambda s: " ".join(f"{k}:{t}" for k, t in X.parse(s)), STRING)(f(text))


@query("fts_stat", "SELECT word, count(DISTINCT p_partkey) AS ndoc, count(*) AS nentry FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def fts_stat(spark, d):
    return X.ts_stat(table(spark, d, "part").select(X.to_tsvector(c("p_name"), "simple").alias("v")), "v")


@query("fts_search_table", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def fts_search_table(spark, d):
    p = table(spark, d, "part")
    least = p.agg(F.min("p_name").alias("least"))
    p = p.crossJoin(F.broadcast(least)).withColumn("word", F.split_part("least", F.lit(" "), F.lit(1)))
    return p.filter(X.matches(X.to_tsvector(c("p_name"), "simple"), X.plainto_tsquery(c("word"), "simple"))).select("p_partkey")


@cases("search_bm25", "SELECT 1", expect("a, b, z", (7.632719, 0.0, 16.291307)))
def _():
    r = lambda x: F.round(x, 6)
    return {"a": r(S.bm25(f("'cat':1 'dog':2,3"), f("cat"))), "b": r(S.bm25(f("'cat':1"), f("bird"))), "z": r(S.bm25(f("'cat':1 'dog':2,3"), f("cat")) + S.bm25(f("'cat':1 'dog':2,3"), f("dog")))}


@query(
    "search_bm25_corpus",
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents), b AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM b), r AS (SELECT doc_id, CASE WHEN a > 0 THEN ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END AS score FROM b, s WHERE a > 0 OR b > 0)
    SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 50""",
)
def search_bm25_corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", f("")).alias("text"))
    return S.rank_bm25(docs, "doc_id", "text", ["the", "and"], 50).select("doc_id", F.round("score", 6).alias("score"))


@query("search_autocomplete", "SELECT p_name AS suggestion FROM part WHERE regexp_matches(p_name, '(^| )re') ORDER BY len(regexp_extract_all(p_name, '(^| )re')) DESC, p_name LIMIT 0")
def search_autocomplete(spark, d):
    return S.autocomplete(table(spark, d, "part"), "p_name", "zzz").select("suggestion")


@query("search_autocomplete_words", expect("suggestion", ("red apple",), ("red rose",), ("a redder rose",)))
def search_autocomplete_words(spark, d):
    t = spark.sql("SELECT * FROM VALUES ('red apple'), ('blue'), ('a redder rose'), ('red rose'), ('bored') AS t(s)")
    return S.autocomplete(t, "s", "red").select("suggestion")


@query("search_synonyms", expect("term, word", ("Car", "car"), ("Car", "auto"), ("Car", "vehicle"), ("x", "x")))
def search_synonyms(spark, d):
    t, s = spark.sql("SELECT * FROM VALUES ('Car'), ('x') AS t(term)"), spark.sql("SELECT * FROM VALUES ('car', 'auto'), ('car', 'Vehicle'), ('bus', 'coach') AS t(term, synonym)")
    return S.expand_synonyms(t, "term", s)


@query("search_analyze", expect("token, type, position", ("The", "asciiword", 1), ("42", "int", 2), ("foo@bar.com", "email", 3), ("x-ray", "asciihword", 4), ("x", "hword_asciipart", 5), ("ray", "hword_asciipart", 6)))
def search_analyze(spark, d):
    return spark.sql("SELECT 'The 42 foo@bar.com x-ray' AS s").select(F.inline(S.analyze(c("s"))))


@cases("search_fuzzy", "SELECT p_partkey, p_name, p_type, p_brand FROM part", "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d, levenshtein(p_brand, 'Brand#11') <= 2 AS m, CASE WHEN levenshtein(p_name, p_type) <= 15 THEN levenshtein(p_name, p_type) ELSE 16 END::INT AS l FROM part")
def _():
    return {"p_partkey": c("p_partkey"), "d": P.edit_distance(c("p_name"), c("p_type")), "m": P.fuzzy_match(c("p_brand"), f("Brand#11")), "l": P.levenshtein_less_equal(c("p_name"), c("p_type"), 15)}


@cases("search_fuzzy_bytes", "SELECT 'é' AS a, 'e' AS b", expect("d, k", (2, 3)))
def _():
    return {"d": P.edit_distance(c("a"), c("b")), "k": P.edit_distance(f("kitten"), f("sitting"))}


NAMES = (("Smith", "SM0", "XMT", "S530", 4), ("Schmidt", "XMT", "SMT", "S530", 4), ("Thomas", "TMS", "TMS", "T520", 2), ("Knight", "NT", "NT", "K523", 1), ("Xavier", "SF", "SFR", "X160", 1), ("Jose", "HS", "HS", "J200", 1), ("Phillip", "FLP", "FLP", "P410", 1), ("Wright", "RT", "RT", "W623", 0), ("Czech", "SK", "XK", "C200", 1))


@cases("search_phonetic", "SELECT * FROM VALUES " + ", ".join(f"('{n[0]}')" for n in NAMES) + " AS t(s)", expect("s, a, b, x, d", *NAMES))
def _():
    s = c("s")
    return {"s": s, "a": P.dmetaphone(s), "b": P.dmetaphone_alt(s), "x": P.soundex(s), "d": P.difference(s, f("Smith"))}


_H = "2 * 6371000 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
_PLACES = "(SELECT c_custkey AS id, (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lon FROM customer)"


@query("search_nearby", f"SELECT id, round(d, 2) AS distance FROM (SELECT id, {_H.format(a='48.0', b='lat', c='11.0', d='lon')} AS d FROM {_PLACES}) WHERE d <= 3000000 ORDER BY d, id LIMIT 100")
def search_nearby(spark, d):
    places = table(spark, d, "customer").select(c("c_custkey").alias("id"), ((c("c_custkey") * 37 % 1800) / 10 - 90).alias("lat"), ((c("c_custkey") * 91 % 3600) / 10 - 180).alias("lon"))
    return S.nearby(places, 48.0, 11.0, 3_000_000.0).select("id", F.round("distance", 2).alias("distance"))
