"""Strings, bytes and patterns, on inputs where the dialect and Spark differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import patterns as R
from tessella.functions import text as X
from tessella.plans.registry import cases, expect

P = "SELECT p_partkey, p_name, p_type, p_brand, p_size FROM part"
c = F.col


@cases("fn_text_slices", P, """SELECT p_partkey, left(p_name, p_size % 9 - 4) AS l, right(p_name, p_size % 9 - 4) AS r, substring(p_name, greatest(p_size % 7 - 3, 1), greatest(4 + least(p_size % 7 - 4, 0), 0)) AS s,
    left(p_name, 2) || 'ZZ' || substr(p_name, 5) AS o, concat(p_brand, NULL, p_size) AS c, strpos(p_name, 'e')::INT AS p, split_part(p_name, ' ', -1) AS last FROM part""")
def _():
    n = c("p_size") % 9 - 4
    return {"p_partkey": c("p_partkey"), "l": X.left(c("p_name"), n), "r": X.right(c("p_name"), n), "s": X.substr(c("p_name"), c("p_size") % 7 - 3, 4), "o": X.overlay(c("p_name"), "ZZ", 3), "c": X.concat(c("p_brand"), None, c("p_size")), "p": X.strpos(c("p_name"), "e"), "last": X.split_part(c("p_name"), " ", -1)}


@cases("fn_text_case", "SELECT * FROM VALUES ('hi THOMAS'), ('hello-world x_y 3d'), ('éa ÉB') AS t(s)", expect("s, i, f", ("hi THOMAS", "Hi Thomas", "hi thomas"), ("hello-world x_y 3d", "Hello-World X_Y 3d", "hello-world x_y 3d"), ("éa ÉB", "Éa Éb", "éa éb")))
def _():
    return {"s": c("s"), "i": X.initcap(c("s")), "f": X.casefold(c("s"))}


@cases("fn_text_trim", "SELECT 'xxabxx' AS s", "SELECT trim('xxabxx', 'x') AS b, ltrim('xxabxx', 'x') AS l, rtrim('xxabxx', 'x') AS r, lpad('ab', 5, 'xy') AS p, left('abcdef', 3) AS q")
def _():
    return {"b": X.trim(c("s"), "x"), "l": X.trim(c("s"), "x", "leading"), "r": X.trim(c("s"), "x", "trailing"), "p": X.lpad(F.lit("ab"), 5, "xy"), "q": X.lpad(F.lit("abcdef"), 3)}


@cases("fn_text_codes", "SELECT * FROM VALUES (65), (233), (8364), (128512) AS t(n)", "SELECT n::INT AS n, chr(n::INT) AS c, unicode(chr(n::INT))::INT AS a, lower(to_base(n, 16)) AS h, to_base(n, 2) AS b, to_base(n, 8) AS o, CASE n WHEN 65 THEN 'ffffffbf' WHEN 233 THEN 'ffffff17' WHEN 8364 THEN 'ffffdf54' ELSE 'fffe0a00' END AS neg FROM (VALUES (65), (233), (8364), (128512)) t(n)")
def _():
    n = c("n")
    return {"n": n, "c": X.chr_(n), "a": X.ascii_(X.chr_(n)), "h": X.to_hex(n), "b": X.to_base(n, 2), "o": X.to_base(n, 8), "neg": X.to_hex(-n, 32)}


@cases(
    "fn_bytes_encode",
    "SELECT unhex('00ff5c416263') AS b, repeat('a', 60) AS s",
    expect("h, e, b64, lines, back, back2, back3", ("00ff5c416263", "\\000\\377\\\\Abc", "AP9cQWJj", ("YWFh" * 19) + "\n" + "YWFh", "00FF5C416263", "00FF5C416263", "00FF5C416263")),
)
def _():
    b = c("b")
    return {"h": X.encode(b, "hex"), "e": X.encode(b, "escape"), "b64": X.encode(b, "base64"), "lines": X.encode(F.encode(c("s"), "UTF-8"), "base64"), "back": F.hex(X.decode(X.encode(b, "hex"), "hex")), "back2": F.hex(X.decode(X.encode(b, "base64"), "base64")), "back3": F.hex(X.decode(X.encode(b, "escape"), "escape"))}


@cases("fn_bytes_bits", "SELECT unhex('1234567890') AS b", expect("byte, setb, bit, setbit, n, utf, latin", (0x90, "1234564290", 1, "1234167890", 15, "E9", "é")))
def _():
    b = c("b")
    return {"byte": X.get_byte(b, 4), "setb": F.hex(X.set_byte(b, 3, 0x42)), "bit": X.get_bit(b, 30), "setbit": F.hex(X.set_bit(b, 22, 0)), "n": X.bit_count(b), "utf": F.hex(X.convert_to(F.lit("é"), "ISO-8859-1")), "latin": X.convert_from(F.unhex(F.lit("E9")), "ISO-8859-1")}


@cases("fn_bytes_hashes", P, "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s256, sha1(p_name) AS s1, 56::INT AS n224, 96::INT AS n384, 128::INT AS n512 FROM part")
def _():
    b = c("p_name")
    return {"p_partkey": c("p_partkey"), "m": F.md5(b), "s256": X.sha(b, 256), "s1": F.sha1(b), "n224": F.length(X.sha(b, 224)), "n384": F.length(X.sha(b, 384)), "n512": F.length(X.sha(b, 512))}


@cases("fn_bytes_known_hashes", "SELECT 'abc' AS s", expect("c, a, b, d", (891568578, "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7", "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7", "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f")))
def _():
    s = c("s")
    return {"c": F.crc32(s), "a": X.sha(s, 224), "b": X.sha(s, 384), "d": X.sha(s, 512)}


@cases("fn_text_unicode", "SELECT 'Ao\\u030A' AS s", expect("n, ok, no, assigned, u, a, w", ("Aå", False, True, True, "data €", "Karel Aa", "Hotel Zurich")))
def _():
    s = F.lit("Aå")
    return {"n": X.normalize(s, "NFC"), "ok": X.is_normalized(s, "NFC"), "no": X.is_normalized(s, "NFD"), "assigned": X.unicode_assigned(s), "u": X.unistr(F.lit(r"d\0061t\+000061 €")), "a": X.to_ascii(F.lit("Karél Áa")), "w": X.unaccent(F.lit("Hôtel Zürich"))}


@cases(
    "fn_text_quoting",
    "SELECT * FROM VALUES ('foo bar', 1), ('user', 2), ('ok_1', 3), ('O''Re\\\\illy', 4), (NULL, 5) AS t(s, k)",
    expect("k, i, l, n", (1, '"foo bar"', "'foo bar'", "'foo bar'"), (2, '"user"', "'user'", "'user'"), (3, "ok_1", "'ok_1'", "'ok_1'"), (4, "\"O'Re\\illy\"", "E'O''Re\\\\illy'", "E'O''Re\\\\illy'"), (5, None, None, "NULL")),
)
def _():
    return {"k": c("k"), "i": X.quote_ident(c("s")), "l": X.quote_literal(c("s")), "n": X.quote_nullable(c("s"))}


@cases("fn_text_format", "SELECT 1", expect("a, b, d, e, p", ("Hello World, 10%", "INSERT INTO \"Foo bar\" VALUES('O''Reilly', NULL)", "|foo       |       bar|", "Testing three, two, three", ["SomeSchema", "sometable"])))
def _():
    return {"a": X.format_("Hello %s, %s%%", "World", 10), "b": X.format_("INSERT INTO %I VALUES(%L, %L)", "Foo bar", "O'Reilly", None), "d": X.format_("|%-10s|%*s|", "foo", 10, "bar"), "e": X.format_("Testing %3$s, %2$s, %s", "one", "two", "three"), "p": X.parse_ident(F.lit('"SomeSchema".someTable'))}


@cases("fn_text_arrays", "SELECT * FROM VALUES (1, 'xx~~yy~~zz'), (2, ''), (3, NULL), (4, 'a.b') AS t(k, s)", expect("k, a, n, ch, j, jn", (1, ["xx", "yy", "zz"], ["xx", None, "zz"], 10, "xx,yy,zz", "xx,*,zz"), (2, [], [], 0, "", ""), (3, None, None, None, None, None), (4, ["a.b"], ["a.b"], 3, "a.b", "a.b")))
def _():
    s = c("s")
    n = X.string_to_array(s, "~~", "yy")
    ch = X.string_to_array(s, None)
    return {"k": c("k"), "a": X.string_to_array(s, "~~"), "n": n, "ch": F.when(ch.isNotNull(), F.size(ch)), "j": X.array_to_string(X.string_to_array(s, "~~"), ","), "jn": X.array_to_string(n, ",", "*")}


@cases("fn_string_to_table", P, "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
def _():
    return {"p_partkey": c("p_partkey"), "w": X.string_to_table(c("p_name"), " ")}


@cases("fn_regexp_replace", P, "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', 'X') AS one, regexp_replace(p_name, '([aeiou])(.)', '<\\2\\1>', 'g') AS alls, regexp_replace(p_name, 'E', 'x', 'gi') AS fold, regexp_replace(p_name, '(e+)', '[\\1$]') AS grp FROM part")
def _():
    s = c("p_name")
    return {"p_partkey": c("p_partkey"), "one": R.regexp_replace(s, "[aeiou]", "X"), "alls": R.regexp_replace(s, "([aeiou])(.)", r"<\2\1>", "g"), "fold": R.regexp_replace(s, "E", "x", "gi"), "grp": R.regexp_replace(s, "(e+)", r"[\&$]")}


@cases(
    "fn_regexp_match",
    "SELECT 'foobarbequebaz' AS s, 'hello world' AS h, 'number of your street, town zip, FR' AS z",
    expect("m, w, none, g, i3, ie, i0, sub, subg, n, b, y", (["bar", "beque"], ["barbeque"], None, "bar/bat", 7, 24, 0, "town zip", "FR", 2, True, "[h]ello [w]orld")),
)
def _():
    s, z = c("s"), c("z")
    return {
        "m": R.regexp_match(s, "(bar)(beque)"), "w": R.regexp_match(s, "barbeque"), "none": R.regexp_match(s, "xyz"),
        "g": F.array_join(F.transform(R.regexp_matches(F.lit("foobarbatx"), "ba.", "g"), lambda m: m[0]), "/"),
        "i3": R.regexp_instr(F.lit("abc de fgh"), r"\w+", 1, 3) - 1, "ie": R.regexp_instr(z, "[^,]+", 1, 1, 1) + 2, "i0": R.regexp_instr(s, "q{2}"),
        "sub": F.trim(R.regexp_substr(z, "[^,]+", 1, 2)), "subg": F.trim(R.regexp_substr(z, ",([^,]*)$", 1, 1, "", 1)), "n": R.regexp_count(F.lit("ABCABCAXYaxy"), "A.", 5, "i"),
        "b": R.regexp_like(c("h"), r"\mworld\M"), "y": R.regexp_replace(c("h"), r"\m(\w)", r"[\1]", "g"),
    }


@cases("fn_regexp_split_table", P, "SELECT p_partkey, unnest(string_split_regex(p_type, '\\s+')) AS w FROM part")
def _():
    return {"p_partkey": c("p_partkey"), "w": R.regexp_split_to_table(c("p_type"), r"\s+")}


@cases("fn_similar_to", P, "SELECT p_partkey, p_name SIMILAR TO '.*(e|a)e.*' AS s, p_brand SIMILAR TO 'Brand#[0-9]+' AS b, p_name LIKE '%e%' AS l, p_name ILIKE 'B%' AS i FROM part")
def _():
    s = c("p_name")
    return {"p_partkey": c("p_partkey"), "s": R.similar_to(s, "%(e|a)e%"), "b": R.similar_to(c("p_brand"), "Brand#[0-9]+"), "l": R.like(s, "%e%", "#"), "i": R.like(s, "B%", fold=True)}


@cases("fn_like_escape", "SELECT * FROM VALUES ('10%'), ('100'), ('a_b'), ('axb') AS t(s)", "SELECT s, s LIKE '%#%' ESCAPE '#' AS p, s LIKE 'a#_b' ESCAPE '#' AS u, CASE s WHEN 'a_b' THEN '^(?:a\\_b|.*0)$' ELSE '^(?:a\\_b|.*0)$' END AS r, CASE s WHEN '100' THEN '0' END AS m FROM (VALUES ('10%'), ('100'), ('a_b'), ('axb')) t(s)")
def _():
    s = c("s")
    return {"s": s, "p": R.like(s, "%#%", "#"), "u": R.like(s, "a#_b", "#"), "r": F.lit(R.similar_to_escape("a#_b|%0", "#")), "m": R.substring_similar(s, '1#"0#"0', "#")}


@cases("fn_nulls", "SELECT * FROM VALUES (1, NULL), (NULL, NULL), (2, 'x') AS t(a, b)", "SELECT a, b, (a IS NULL)::INT + (b IS NULL)::INT AS n, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS k FROM (VALUES (1, NULL), (NULL, NULL), (2, 'x')) t(a, b)")
def _():
    n, k = X.nulls(c("a"), c("b"))
    return {"a": c("a"), "b": c("b"), "n": n, "k": k}
