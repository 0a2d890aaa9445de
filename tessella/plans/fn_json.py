"""JSON documents and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import jsonb as J
from tessella.plans.registry import cases, expect, query
from tessella.session import table

c = F.col
E = "SELECT event_id, event_type, props FROM events"
DOC = """SELECT '{"a": {"b": [1, 2, {"c": "x"}], "n": null}, "t": "hi", "f": 1.50, "ok": true}' AS d, '[1, [2, 3], {"k": "v"}, "s", null]' AS l"""


@cases("fn_json_access", DOC, expect("a, b, d, e, f, g, h, i", ('{"b": [1, 2, {"c": "x"}], "n": null}', "hi", "2", "x", "1.50", None, '"s"', None)))
def _():
    d, l = c("d"), c("l")  # noqa: E741
    path = lambda *p: F.array(*[F.lit(x) for x in p])
    return {"a": J.arrow(d, "a"), "b": J.arrow_text(d, "t"), "d": J.extract_path(d, path("a", "b", "1")), "e": J.extract_path_text(d, path("a", "b", "-1", "c")), "f": J.arrow(d, "f"), "g": J.arrow(d, "zz"), "h": J.arrow(l, -2), "i": J.extract_path_text(d, path("a", "n"))}


@cases("fn_json_events", E, "SELECT event_id, (props->'k')::VARCHAR AS k, json_type(props, '$.k') = 'UBIGINT' OR json_type(props, '$.k') = 'BIGINT' AS num, json_exists(props, '$.k') AS has, json_exists(props, '$.zz') AS zz, (props->>'$.k')::INT > 50 AS big FROM events")
def _():
    p = c("props")
    return {"event_id": c("event_id"), "k": J.arrow(p, "k"), "num": J.typeof(J.arrow(p, "k")) == "number", "has": J.exists(p, "k"), "zz": J.path_exists(p, "$.zz"), "big": J.path_match(p, "$.k > 50")}


@cases("fn_json_compare", DOC, expect("a, b, d, e, f, g, h, i, j, k, l, m", (True, False, True, True, True, False, True, False, 1, -1, 0, True)))
def _():
    d, l = c("d"), c("l")  # noqa: E741
    lit = F.lit
    ks = lambda *x: F.array(*[lit(v) for v in x])
    return {
        "a": J.contains(d, lit('{"a": {"b": [2]}}')), "b": J.contains(d, lit('{"a": {"b": 2}}')), "d": J.contains(l, lit("1")), "e": J.contained(lit("[1, 1]"), l), "f": J.exists(l, "s"), "g": J.exists(d, "b"),
        "h": J.exists_any(d, ks("zz", "t")), "i": J.exists_all(d, ks("zz", "t")), "j": J.cmp(lit('{"a":1}'), lit("[1,2,3]")), "k": J.cmp(lit("[1,2]"), lit("[1,3]")), "l": J.cmp(lit('{"a":1, "b":2}'), lit('{"b":2,"a":1.0}')),
        "m": J.hash_(lit('{"a":1, "b":2}')) == J.hash_(lit('{"b":2,"a":1}')),
    }


@cases(
    "fn_json_change",
    "SELECT 1",
    expect(
        "a, b, d, e, f, g, h, i, j, k, l, m, n",
        ('[{"f1": [2, 3, 4], "f2": null}, 2, null, 3]', '[{"f1": 1, "f2": null, "f3": [2, 3, 4]}, 2]', '{"a": [0, "new", 1, 2]}', '{"a": [0, 1, "new", 2]}', '{"a": "b", "c": "d"}', '["a", "b", "c"]', '{"c": "d"}', '["a"]', '["a", {}]', '{"f1": 1}', "[1, 2]", '{"a": 1}', '{"a": null}'),
    ),
)
def _():
    x, lit = F.lit('[{"f1":1,"f2":null},2,null,3]'), F.lit
    y, z = lit('[{"f1":1,"f2":null},2]'), lit('{"a": [0,1,2]}')
    return {
        "a": J.set_(x, ["0", "f1"], lit("[2,3,4]"), False), "b": J.set_(y, ["0", "f3"], lit("[2,3,4]")), "d": J.insert(z, ["a", "1"], lit('"new"')), "e": J.insert(z, ["a", "1"], lit('"new"'), True),
        "f": J.concat(lit('{"a":"b"}'), lit('{"c":"d"}')), "g": J.concat(lit('["a","b"]'), lit('"c"')), "h": J.delete(lit('{"a":"b","c":"d"}'), "a"), "i": J.delete(lit('["a","b"]'), 1),
        "j": J.delete_path(lit('["a", {"b":1}]'), F.array(lit("1"), lit("b"))), "k": J.strip_nulls(lit('{"f1":1,"f2":null}')), "l": J.strip_nulls(lit("[1,null,2]"), True),
        "m": J.set_lax(lit('{"a":1,"b":2}'), ["b"], lit(None).cast("string"), True, "delete_key"), "n": J.set_lax(lit('{"a":1}'), ["a"], lit(None).cast("string")),
    }


@cases("fn_json_pretty", DOC, expect("p, c, t, n, k, v, s, bad", ('[\n    {\n        "f1": 1,\n        "f2": null\n    },\n    2\n]', '{"b": 2, "aa": 1}', ["object", "array", "string", "number", "boolean", "null"], 5, ["a", "f", "t", "ok"], True, False, False)))
def _():
    lit = F.lit
    return {
        "p": J.pretty(lit('[{"f1":1,"f2":null}, 2]')), "c": J.canonical(lit('{"aa":1, "b":3, "b":2}')), "t": F.array(*[J.typeof(lit(x)) for x in ("{}", "[]", '"a"', "1", "true", "null")]),
        "n": J.array_length(c("l")), "k": J.object_keys(c("d")), "v": J.is_json(c("d"), "object"), "s": J.is_json(c("l"), "scalar"), "bad": J.is_json(lit("{a}"), "value"),
    }


@cases("fn_json_build", "SELECT 1 AS x, 'a\"b' AS s, CAST(NULL AS int) AS z, array(1, 2) AS l", expect("o, a, ob, r, t, n, q", ('{"foo" : 1, "2" : "a\\"b"}', '[1, "a\\"b", null, [1,2]]', '{"a" : "1", "b" : null}', '{"x":1,"z":null}', '"a\\"b"', None, "[1,2]")))
def _():
    return {"o": J.build_object("foo", c("x"), 2, c("s")), "a": J.build_array(c("x"), c("s"), c("z"), c("l")), "ob": J.object_(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit(None).cast("string"))), "r": J.row_to_json("x", "z"), "t": J.to_json(c("s")), "n": J.to_json(c("z")), "q": J.to_json(c("l"))}


@query("fn_json_agg", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ', ' ORDER BY n_nationkey) || ']' AS names, '{' || string_agg('\"' || n_name || '\": ' || n_nationkey, ', ' ORDER BY strlen(n_name), n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def json_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(J.agg(c("n_name"), c("n_nationkey")).alias("names"), J.object_agg(c("n_name"), c("n_nationkey")).alias("o"))


@query("fn_json_each", "SELECT event_id, unnest(json_keys(props)) AS key, props->>('$.' || unnest(json_keys(props))) AS value FROM events")
def json_each(spark, d):
    return table(spark, d, "events").select("event_id", F.inline(J.each(c("props"), True)))


@query("fn_json_elements", expect("e, t", ("1", "1"), ('"a"', "a"), ("null", None), ("[true]", "[true]")))
def json_elements(spark, d):
    one = spark.sql("""SELECT '[1, "a", null, [true]]' AS l""")
    return one.select(F.arrays_zip(J.elements(c("l")).alias("e"), J.elements_text(c("l")).alias("t")).alias("p")).select(F.inline("p"))


@query("fn_json_records", "SELECT * FROM (VALUES (1, 'x', 2.5::DOUBLE), (2, NULL, NULL)) t(a, b, d)")
def json_records(spark, d):
    one = spark.sql("""SELECT '[{"a": 1, "b": "x", "d": 2.5, "more": 0}, {"a": 2}]' AS s""")
    return one.select(J.to_recordset(c("s"), "a int, b string, d double"))


@cases("fn_json_populate", "SELECT named_struct('a', 7, 'b', 'old') AS base, '{\"b\": \"new\"}' AS s", expect("a, b, x", (7, "new", 5)))
def _():
    r = J.populate_record(c("base"), c("s"), "a int, b string")
    return {"a": r["a"], "b": r["b"], "x": J.to_record(F.lit('{"x": 5, "y": 6}'), "x int")["x"]}


PATHS = {
    '{"a":[1,2,3,4,5]}': [("$.a[*] ? (@ >= 2 && @ <= 4)", ["2", "3", "4"]), ("$.a.size()", ["5"]), ("$.a[last]", ["5"]), ("$.a[0 to 1, 4]", ["1", "2", "5"]), ("$.a[*] * 2", None), ("$.a[0] + 3 * $.a[1]", ["7"]), ("-$.a[0 to 1]", ["-1", "-2"]), ("$ ? (exists (@.a[*] ? (@ > 4))).a[0]", ["1"]), ("$.b", []), ("strict $.b", None)],
    '{"t":{"s":[{"l":[47.763,13.4034],"h":73},{"l":[47.7,13.2],"h":135}]},"n":null}': [
        ("$.t.s[*].h ? (@ > 130)", ["135"]), ("$.t.s[*] ? (@.l[1] < 13.4) ? (@.h > 130).h", ["135"]), ("$.t.s.size()", ["2"]), ("lax $.t.s.l", ["[47.763, 13.4034]", "[47.7, 13.2]"]), ("$.t.s[*].h.type()", ['"number"', '"number"']),
        ("$.**.h", ["73", "135", "73", "135"]), ("strict $.**.h ? (@ < 100)", None), ("$.n == null", ["true"]), ("$.keyvalue().key", ['"t"', '"n"']), ("$.t.s[0].l[*].floor()", ["47", "13"]), ("$.t.* ? (@.h == 73).h", ["73"]),
    ],
    '["abc","abd","aBc","xyz", 1, "2.5"]': [('$[*] ? (@ like_regex "^ab.*c")', ['"abc"']), ('$[*] ? (@ like_regex "^AB" flag "i")', ['"abc"', '"abd"', '"aBc"']), ('$[*] ? (@ starts with "ab")', ['"abc"', '"abd"']), ("$[last].double()", ["2.5"]), ("$[*] ? ((@ > 0) is unknown)", ['"abc"', '"abd"', '"aBc"', '"xyz"', '"2.5"']), ("$[4] > 0 || $[0] == 1", ["true"]), ("!($[4] > 5)", ["true"]), ("$[0] ? (@ == $v)", ['"abc"'])],
}


@query("fn_jsonpath_query", expect("d, p, r", *[(d, p, r) for d, ps in PATHS.items() for p, r in ps]))
def jsonpath_query(spark, d):
    parts = [spark.sql("SELECT :d AS d", {"d": doc}).select("d", F.lit(p).alias("p"), J.path_query_all(c("d"), p, {"v": "abc"}, True).alias("r") if r is not None else F.nullif(J.path_query_all(c("d"), p, {}, True), F.array().cast("array<string>")).alias("r")) for doc, ps in PATHS.items() for p, r in ps]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@cases("fn_jsonpath_sql", DOC, expect("ex, m, arr, first, v, dv, q, w, cw, uq", (True, True, '[1, 2, {"c": "x"}]', "1", "hi", "none", '{"c": "x"}', "[1, 2]", '["hi"]', "hi")))
def _():
    d = c("d")
    return {
        "ex": J.path_exists(d, "$.a.b[*] ? (@ == 2)"), "m": J.path_match(d, "$.f == 1.5"), "arr": J.path_query_array(d, "$.a.b[*]"), "first": J.path_query_first(d, "$.a.b[*]"), "v": J.json_value(d, "$.t"), "dv": J.json_value(d, "$.a", "none"),
        "q": J.json_query(d, "$.a.b[2]"), "w": J.json_query(d, "$.a.b[0 to 1]", "unconditional"), "cw": J.json_query(d, "$.t", "conditional"), "uq": J.json_query(d, "$.t", quotes=False),
    }


@query("fn_json_table", expect("id, kind, title, director, has", (1, "comedy", "Bananas", "Woody Allen", True), (2, "comedy", "The Dinner Game", None, False), (3, "horror", "Psycho", "Alfred Hitchcock", True)))
def json_table(spark, d):
    text = '{"favorites":[{"kind":"comedy","films":[{"title":"Bananas","director":"Woody Allen"},{"title":"The Dinner Game"}]},{"kind":"horror","films":[{"title":"Psycho","director":"Alfred Hitchcock"}]}]}'
    one = spark.sql("SELECT :t AS s", {"t": text})
    outer = one.select(F.inline(J.json_table(c("s"), "$.favorites[*]", {"n": ("ordinality", ""), "kind": ("string", "$.kind"), "films": ("string", "$.films")})))
    inner = outer.select("n", "kind", F.inline(J.json_table(c("films"), "$[*]", {"i": ("ordinality", ""), "title": ("string", "$.title"), "director": ("string", "$.director"), "has": ("exists", "$.director")})))
    from pyspark.sql import Window

    return inner.select(F.row_number().over(Window.orderBy("n", "i")).alias("id"), "kind", "title", "director", "has")
