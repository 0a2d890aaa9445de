"""Ranges, addresses, geometry, key-value maps, label trees, trigrams, enumerations, identifiers, XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import kinds as K
from tessella.functions import network as N
from tessella.functions import ranges as R
from tessella.plans.registry import cases, expect, query
from tessella.session import table

c = F.col

SQL_PAIRS = "(SELECT a.s_suppkey AS k, least(a.s_suppkey % 20, b.s_suppkey % 17) AS al, greatest(a.s_suppkey % 20, b.s_suppkey % 17) AS ah, b.s_suppkey % 13 AS bl, b.s_suppkey % 13 + a.s_suppkey % 7 AS bh, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey)"


@query("fn_range_operators", f"""SELECT k, j, al = ah AS e, (bl = bh OR (al < ah AND al <= bl AND ah >= bh)) AS c, (al < ah AND bl < bh AND al < bh AND bl < ah) AS o, (al < ah AND bl < bh AND ah <= bl) AS l, (al < ah AND bl < bh AND (ah = bl OR bh = al)) AS adj,
    (al < ah AND 5 >= al AND 5 < ah) AS has, CASE WHEN al < ah AND bl < bh AND al < bh AND bl < ah THEN '[' || greatest(al, bl) || ',' || least(ah, bh) || ')' ELSE 'empty' END AS i,
    CASE WHEN al = ah AND bl = bh THEN 'empty' WHEN al = ah THEN '[' || bl || ',' || bh || ')' WHEN bl = bh THEN '[' || al || ',' || ah || ')' ELSE '[' || least(al, bl) || ',' || greatest(ah, bh) || ')' END AS m,
    (al < ah AND bl < bh AND ah <= bh) AS nr, (al < ah AND bl < bh AND al >= bl) AS nl FROM {SQL_PAIRS}""")
def range_operators(spark, d):
    """Pairs grow with the square of a nation's suppliers. They are made where the left rows are, and these are dealt to all cores;
    the operators run once for each pair of ranges that differ: 20 * 7 * 17 * 13 at most, however many suppliers."""
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("k"), "s_nationkey")
    left, right = s.select("k", "s_nationkey", (c("k") % 20).alias("k20"), (c("k") % 7).alias("k7")), s.select(c("k").alias("j"), "s_nationkey", (c("k") % 17).alias("j17"), (c("k") % 13).alias("j13"))
    ends = [F.least("k20", "j17").alias("al"), F.greatest("k20", "j17").alias("ah"), c("j13").alias("bl"), (c("j13") + c("k7")).alias("bh")]
    pairs = left.repartition(4 * max(2, spark.sparkContext.defaultParallelism), "k").join(F.broadcast(right), "s_nationkey").select("k", "j", *ends)
    a, b = R.range_(c("al"), c("ah"), step=1), R.range_(c("bl"), c("bh"), step=1)
    out = {"e": R.isempty(a), "c": R.contains(a, b), "o": R.overlaps(a, b), "l": R.left_of(a, b), "adj": R.adjacent(a, b), "has": R.contains_elem(a, 5), "i": R.text(R.intersection(a, b)), "m": R.text(R.merge(a, b)), "nr": R.not_right(a, b), "nl": R.not_left(a, b)}
    kinds = left.select("k20", "k7").distinct().crossJoin(F.broadcast(right.select("j17", "j13").distinct())).select(*ends).distinct()
    kinds = kinds.select(*[c(n).alias(f"_{n}") for n in ("al", "ah", "bl", "bh")], *[v.alias(n) for n, v in out.items()])
    same = [c(n).eqNullSafe(c(f"_{n}")) for n in ("al", "ah", "bl", "bh")]
    return pairs.join(F.broadcast(kinds), same[0] & same[1] & same[2] & same[3]).select("k", "j", *out)


@cases("fn_range_bounds", "SELECT 1", expect("i4, n, inf, e, d, lo, hi, li, ui, lf, uf, un, df, adj", ("[2,6)", "(1.5,2.5]", "(,5)", "empty", "[2024-01-01,2024-02-01)", 2, 6, True, False, True, True, "[1,9)", "[1,4)", True)))
def _():
    r, f = R.range_, F.lit
    i4, n, inf = r(f(1), f(5), "(]", step=1), r(f(1.5), f(2.5), "(]"), r(f(None).cast("int"), f(5))
    day = lambda s: f(s).cast("date")
    d = r(day("2024-01-01"), day("2024-01-31"), "[]", step=1)
    return {
        "i4": R.text(i4), "n": R.text(n), "inf": R.text(inf), "e": R.text(r(f(3), f(3))), "d": R.text(d), "lo": R.lower(i4), "hi": R.upper(i4), "li": R.lower_inc(i4), "ui": R.upper_inc(i4), "lf": R.lower_inf(inf),
        "uf": R.upper_inf(r(f(1), f(None).cast("int"))), "un": R.text(R.union(r(f(1), f(5)), r(f(5), f(9)))), "df": R.text(R.difference(r(f(1), f(9)), r(f(4), f(12)))), "adj": R.adjacent(r(f(1.0), f(2.0)), r(f(2.0), f(3.0))),
    }


@query(
    "fn_range_agg",
    """WITH r AS (SELECT s_nationkey AS g, s_suppkey % 40 AS lo, s_suppkey % 40 + s_suppkey % 5 AS hi FROM supplier), x AS (SELECT * FROM r WHERE lo < hi),
    m AS (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x), s AS (SELECT *, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
    i AS (SELECT g, island, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY ALL), t AS (SELECT g, string_agg('[' || lo || ',' || hi || ')', ',' ORDER BY lo) AS t, '[' || min(lo) || ',' || max(hi) || ')' AS h FROM i GROUP BY g),
    e AS (SELECT g, CASE WHEN bool_or(lo >= hi) OR max(lo) >= min(hi) THEN 'empty' ELSE '[' || max(lo) || ',' || min(hi) || ')' END AS both_ FROM r GROUP BY g)
    SELECT e.g, '{' || coalesce(t, '') || '}' AS m, both_, coalesce(h, 'none') AS hull FROM e LEFT JOIN t USING (g)""",
)
def range_agg(spark, d):
    s = table(spark, d, "supplier").select(c("s_nationkey").alias("g"), R.range_(c("s_suppkey") % 40, c("s_suppkey") % 40 + c("s_suppkey") % 5, step=1).alias("r"))
    m = s.groupBy("g").agg(R.range_agg(c("r")).alias("m"), R.range_intersect_agg(c("r")).alias("b"))
    return m.select("g", R.multirange_text(c("m")).alias("m"), R.text(c("b")).alias("both_"), F.coalesce(R.text(R.m_merge(c("m"))), F.lit("none")).alias("hull"))


@cases("fn_multirange", "SELECT 1", expect("m, u, i, d, has, inside, o, hull", ("{[1,5),[7,9)}", "{[1,12)}", "{[3,5),[7,8)}", "{[1,3),[8,9)}", True, True, False, "[1,9)")))
def _():
    r = lambda a, b: R.range_(F.lit(a), F.lit(b), step=1)
    m, other = R.multirange(F.array(r(7, 9), r(1, 3), r(3, 5), r(2, 2))), R.multirange(F.array(r(3, 8)))
    return {"m": R.multirange_text(m), "u": R.multirange_text(R.m_union(m, F.array(r(4, 12)))), "i": R.multirange_text(R.m_intersection(m, other)), "d": R.multirange_text(R.m_difference(m, other)), "has": R.m_contains_elem(m, 4), "inside": R.m_contains(m, F.array(r(1, 2), r(7, 8))), "o": R.m_overlaps(m, F.array(r(5, 7))), "hull": R.text(R.m_merge(m))}


@cases(
    "fn_network",
    "SELECT * FROM VALUES ('192.168.1.5/24', '192.168.1.0/25'), ('10.0.0.1', '10.0.0.0/8'), ('::ffff:1.2.3.4/120', '::1/128') AS t(a, b)",
    expect(
        "a, h, t, f, ml, nm, hm, n, bc, sm, fam, w, o, p, ab",
        ("192.168.1.5/24", "192.168.1.5", "192.168.1.5/24", 4, 24, "255.255.255.0", "0.0.0.255", "192.168.1.0/24", "192.168.1.255/24", "192.168.1.5/16", True, False, True, "192.168.1.15/24", "192.168.1/24"),
        ("10.0.0.1", "10.0.0.1", "10.0.0.1/32", 4, 32, "255.255.255.255", "0.0.0.0", "10.0.0.1/32", "10.0.0.1", "10.0.0.1/16", True, True, True, "10.0.0.11", "10.0.0.1/32"),
        ("::ffff:1.2.3.4/120", "::ffff:1.2.3.4", "::ffff:1.2.3.4/120", 6, 120, "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ff00", "::ff", "::ffff:1.2.3.0/120", "::ffff:1.2.3.255/120", "::ffff:1.2.3.4/16", True, False, False, "::ffff:1.2.3.14/120", "::ffff:1.2.3.4/120"),
    ),
)
def _():
    a, b = c("a"), c("b")
    return {"a": a, "h": N.host(a), "t": N.text(a), "f": N.family(a), "ml": N.masklen(a), "nm": N.netmask(a), "hm": N.hostmask(a), "n": N.network(a), "bc": N.broadcast(a), "sm": N.set_masklen(a, 16), "fam": N.inet_same_family(a, b), "w": N.within(a, b), "o": N.overlaps(a, b), "p": N.plus(a, 10), "ab": N.abbrev(a, True)}


@cases("fn_network_more", "SELECT 1", expect("m, d, a, o, n, ce, cq, wq, s, mac, t, m8, s7, ma, mo, mn", ("192.168.0.0/22", 9, "192.168.0.4", "192.168.1.6/24", "63.87.254.250/24", True, True, True, True, "08:00:2b:01:02:03", "08:00:2b:00:00:00", "08:00:2b:ff:fe:01:02:03", "0a:00:2b:ff:fe:01:02:03", "00:00:2b:01:02:00", "08:00:2b:01:02:ff", "f7:ff:d4:fe:fd:fc")))
def _():
    f = F.lit
    m = f("08002b:010203")
    return {
        "m": N.inet_merge(f("192.168.1.5/24"), f("192.168.2.5/24")), "d": N.minus(f("192.168.1.43"), f("192.168.1.34")), "a": N.bit_and(f("192.168.1.6"), f("192.168.0.4")), "o": N.bit_or(f("192.168.1.6/24"), f("192.168.0.4/24")), "n": N.bit_not(f("192.168.1.5/24")),
        "ce": N.contains(f("192.168.1/24".replace("1/", "1.0/")), f("192.168.1.5")), "cq": N.contains_or_equal(f("192.168.1.0/24"), f("192.168.1.0/24")), "wq": N.within_or_equal(f("10.1.1.1"), f("10.0.0.0/8")), "s": N.sort_key(f("9.1.1.1")) < N.sort_key(f("10.1.1.1")),
        "mac": N.macaddr(m), "t": N.trunc_macaddr(m), "m8": N.macaddr8(m), "s7": N.macaddr8_set7bit(m), "ma": N.mac_and(m, f("00:ff:ff:ff:ff:00")), "mo": N.mac_or(m, f("00:00:00:00:00:ff")), "mn": N.mac_not(m),
    }


@cases("fn_geometry", "SELECT 1", expect("ar, ce, h, w, di, bb, ca, cd, cb, pa, pc, np, pl, po, sl, d", (4.0, "(1,1)", 2.0, 2.0, "(2,2)", "(4,3)", 12.566371, 4.0, "(1.414214,1.414214)", 12.0, "(2,1.5)", 4, 14.0, 11.0, 0.5, 5.0)))
def _():
    p, r = G.point, lambda x: F.round(x, 6)
    b = G.box(p(0, 2), p(2, 0))
    ci = G.circle(p(0, 0), 2)
    poly = F.array(p(0, 0), p(4, 0), p(4, 3), p(0, 3))
    path = G.path(poly, True)
    return {
        "ar": G.box_area(b), "ce": G.point_text(G.box_center(b)), "h": G.height(b), "w": G.width(b), "di": G.point_text(G.diagonal(b)["a"]), "bb": G.point_text(G.bound_box(b, G.box(p(3, 3), p(4, 1)))["high"]), "ca": r(G.circle_area(ci)), "cd": G.diameter(ci), "cb": G.point_text(G.circle_box(ci)["high"]),
        "pa": G.polygon_area(poly), "pc": G.point_text(G.polygon_center(poly)), "np": G.npoints(poly), "pl": G.path_length(path), "po": G.path_length(G.popen(path)), "sl": G.slope(p(0, 0), p(2, 1)), "d": G.distance(p(0, 0), p(3, 4)),
    }


@cases("fn_geometry_operators", "SELECT 1", expect("tr, mu, dv, bc, bo, bi, cc, cd, ld, cp, sm, sn, hz, vt, pl, pp, pin, pout, lf, ab, cl, op, rad, cpoly, bcir", ("(4,6)", "(-5,10)", "(5,0)", True, True, "(2,2)", True, 1.0, 1.414214, "(1,0)", True, False, True, True, True, True, True, False, True, True, True, False, 2.0, 12, 1.414214)))
def _():
    p, r = G.point, lambda x: F.round(x, 6)
    b, b2 = G.box(p(0, 0), p(2, 2)), G.box(p(1, 1), p(3, 3))
    s = lambda *x: G.lseg(p(x[0], x[1]), p(x[2], x[3]))
    tri = F.array(p(0, 0), p(4, 0), p(0, 4))
    path = G.path(tri, True)
    return {
        "tr": G.point_text(G.translate(p(1, 2), p(3, 4))), "mu": G.point_text(G.multiply(p(1, 2), p(3, 4))), "dv": G.point_text(G.divide(p(5, 10), p(1, 2))),
        "bc": G.box_contains_point(b, p(1, 2)), "bo": G.box_overlaps(b, b2), "bi": G.point_text(G.box_intersection(b, b2)["high"]), "cc": G.circle_contains_point(G.circle(p(0, 0), 5), p(3, 4)), "cd": G.circle_distance(G.circle(p(0, 0), 1), G.circle(p(4, 0), 2)),
        "ld": r(G.line_distance(p(0, 2), G.line(p(0, 0), p(1, 1)))), "cp": G.point_text(G.closest_point(p(1, 5), s(0, 0, 4, 0))), "sm": G.segments_meet(s(0, 0, 2, 2), s(0, 2, 2, 0)), "sn": G.segments_meet(s(0, 0, 1, 1), s(3, 0, 3, 5)),
        "hz": G.is_horizontal(s(0, 1, 5, 1)), "vt": G.is_vertical(s(2, 0, 2, 9)), "pl": G.is_parallel(s(0, 0, 1, 1), s(5, 0, 7, 2)), "pp": G.is_perpendicular(s(0, 0, 1, 1), s(0, 0, 1, -1)), "pin": G.polygon_contains_point(tri, p(1, 1)), "pout": G.polygon_contains_point(tri, p(3, 3)),
        "lf": G.left_of(b, G.box(p(3, 0), p(4, 1))), "ab": G.above(G.box(p(0, 3), p(1, 4)), b), "cl": G.isclosed(path), "op": G.isopen(G.pclose(path)), "rad": G.radius(G.circle(p(0, 0), 2)), "cpoly": G.npoints(G.circle_polygon(G.circle(p(0, 0), 1))), "bcir": r(G.radius(G.box_circle(b))),
    }


@query("fn_hstore", expect("t, g, e, n, all_, any_, cat, d, has, sl, keys", ('"a"=>"1", "n"=>NULL, "b c"=>"x\\"y"', "1", True, None, False, True, '"a"=>"2", "n"=>NULL, "z"=>"9", "b c"=>"x\\"y"', '"n"=>NULL, "b c"=>"x\\"y"', True, '"a"=>"1"', ["a", "b c", "n"])))
def hstore(spark, d):
    one = spark.sql("""SELECT 'a=>1, "b c"=>"x\\\\"y", n=>NULL' AS s""").select(K.hstore(c("s")).alias("h"))
    h = c("h")
    other = F.create_map(F.lit("a"), F.lit("2"), F.lit("z"), F.lit("9"))
    return one.select(K.hstore_text(h).alias("t"), K.h_get(h, "a").alias("g"), K.h_exists(h, "n").alias("e"), K.h_get(h, "zz").alias("n"), K.h_exists_all(h, ["a", "zz"]).alias("all_"), K.h_exists_any(h, ["a", "zz"]).alias("any_"), K.hstore_text(K.h_concat(h, other)).alias("cat"), K.hstore_text(K.h_delete(h, ["a"])).alias("d"), K.h_contains(h, F.create_map(F.lit("a"), F.lit("1"))).alias("has"), K.hstore_text(K.h_slice(h, ["a"])).alias("sl"), K.h_keys(h).alias("keys"))


@cases(
    "fn_ltree",
    "SELECT * FROM VALUES ('Top.Science.Astronomy.Astrophysics'), ('Top.Hobbies.Amateurs_Astronomy'), ('Top') AS t(s)",
    expect("s, n, sp, tail, anc, q1, q2, q3, l", ("Top.Science.Astronomy.Astrophysics", 4, "Science.Astronomy", "Astrophysics", True, True, True, False, "Top.Science"), ("Top.Hobbies.Amateurs_Astronomy", 3, "Hobbies.Amateurs_Astronomy", "Amateurs_Astronomy", False, False, False, True, "Top"), ("Top", 1, "", "Top", False, False, False, False, "")),
)
def _():
    s = c("s")
    return {"s": s, "n": K.nlevel(s), "sp": K.subpath(s, 1, 2), "tail": K.subpath(s, -1), "anc": K.is_ancestor(F.lit("Top.Science"), s), "q1": K.matches(s, "*.Astronomy.*"), "q2": K.matches(s, "*.astro*@.*{1}"), "q3": K.matches(s, "Top.!Science.*"), "l": K.lca(s, F.lit("Top.Science.Physics"))}


@cases("fn_trigrams", "SELECT * FROM VALUES ('word', 'two words'), ('cat', 'dog'), ('', '') AS t(a, b)", expect("a, s, w, l, g", ("word", 0.363636, 0.8, True, ["  w", " wo", "ord", "rd ", "wor"]), ("cat", 0.0, 0.0, False, ["  c", " ca", "at ", "cat"]), ("", 0.0, 0.0, False, [])))
def _():
    a, b = c("a"), c("b")
    return {"a": a, "s": F.round(K.similarity(a, b), 6), "w": F.round(K.word_similarity(a, b), 6), "l": K.similar(a, b), "g": K.show_trgm(a)}


@cases("fn_cube", "SELECT 1", expect("d, s, dist, has, o, u, e, earth", (2, 6.0, 5.0, True, False, 9.0, 20.0, 111320)))
def _():
    ar = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    a, b = K.cube(ar(0, 0), ar(2, 3)), K.cube(ar(5, 7))
    return {"d": K.cube_dim(a), "s": K.cube_size(a), "dist": K.cube_distance(a, b), "has": K.cube_contains(a, K.cube(ar(1, 1))), "o": K.cube_overlap(a, b), "u": K.cube_size(K.cube_union(a, K.cube(ar(3, 3)))), "e": K.cube_size(K.cube_enlarge(a, 1.0)), "earth": F.round(K.earth_distance(0.0, 0.0, 0.0, 1.0)).cast("long")}


@cases("fn_enum", "SELECT * FROM VALUES ('sad'), ('ok'), ('happy') AS t(m)", expect("m, o, f, l, r, r2", ("sad", 1, "sad", "happy", ["sad", "ok", "happy"], ["ok", "happy"]), ("ok", 2, "sad", "happy", ["sad", "ok", "happy"], ["ok", "happy"]), ("happy", 3, "sad", "happy", ["sad", "ok", "happy"], ["ok", "happy"])))
def _():
    e = K.Enum("sad", "ok", "happy")
    return {"m": c("m"), "o": e.order(c("m")), "f": e.first(), "l": e.last(), "r": e.range(), "r2": e.range("ok")}


@cases("fn_uuid", "SELECT TIMESTAMP '2024-05-01 10:00:00.123' AS at", expect("v4, v7, t7, t1, v3, v5, nov, same", (4, 7, "2024-05-01 10:00:00.123", "1998-02-04 22:13:53.151", "3d813cbb-47fb-32ba-91df-831e1593ac29", "886313e1-3b8a-5372-9b90-0c9aee199e5d", None, True)))
def _():
    f = F.lit
    u7 = K.uuidv7(c("at"), 1, f("k"))
    dns = f("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    show = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")
    return {"v4": K.uuid_extract_version(K.gen_random_uuid(1, f("k"))), "v7": K.uuid_extract_version(u7), "t7": show(K.uuid_extract_timestamp(u7)), "t1": show(K.uuid_extract_timestamp(dns)), "v3": K.uuid_v3(dns, f("www.widgets.com")), "v5": K.uuid_v5(dns, f("python.org")), "nov": K.uuid_extract_version(f("11111111-1111-1111-0111-111111111111")), "same": K.gen_random_uuid(1, f("k")) == K.gen_random_uuid(1, f("k"))}


@cases("fn_digest", "SELECT encode('abc', 'UTF-8') AS b", expect("d, m, h", ("a9993e364706816aba3e25717850c26c9cd0d89d", "900150983cd24fb0d6963f7d28e17f72", "9c196e32dc0175f86f4b1cb89289d6619de6bee699e4c378e68309ed97a1a6ab")))
def _():
    hx = lambda b: F.lower(F.hex(b))
    return {"d": hx(K.digest(c("b"), F.lit("sha1"))), "m": hx(K.digest(c("b"), F.lit("md5"))), "h": hx(K.hmac(c("b"), F.encode(F.lit("key"), "UTF-8"), F.lit("sha256")))}


@cases("fn_lsn", "SELECT '16/B374D848' AS a, '16/B3740000' AS b", expect("d, t, g, m, w, w1, ba, bo, bx, bn, bs, br", (55368, "16/B374D84C", True, "-$1,234.50", "Nine hundred twelve dollars and forty five cents", "One dollar and one cent", "00001", "01101", "01100", "10110", "01000", "00010")))
def _():
    a, b, f = K.lsn(c("a")), K.lsn(c("b")), F.lit
    return {"d": a - b, "t": K.lsn_text(a + 4), "g": a > b, "m": K.money_text(f(-1234.5)), "w": K.cash_words(f(912.45)), "w1": K.cash_words(f(1.01)), "ba": K.bits_and(f("01001"), f("00101")), "bo": K.bits_or(f("01001"), f("00101")), "bx": K.bits_xor(f("01001"), f("00101")), "bn": K.bits_not(f("01001")), "bs": K.bits_shift(f("10001"), 3), "br": K.bits_shift(f("01001"), -2)}


@cases("fn_xml", "SELECT 'a<b' AS t, 7 AS n, CAST(NULL AS string) AS z", expect("e, att, f, c, cm, w, wd, x, ex, p", ("<foo>a&lt;b</foo>", '<foo id="7"><bar>7</bar></foo>', "<t>a&lt;b</t><n>7</n>", "<t>a&lt;b</t><b/>", "<!--hi-->", True, False, ["x", "y"], True, "<a>ok</a>")))
def _():
    t, n, z = c("t"), c("n"), c("z")
    doc = F.lit("<r><a>x</a><a>y</a></r>")
    return {"e": K.xmlelement("foo", t), "att": K.xmlelement("foo", K.Xml(K.xmlelement("bar", n)), attributes={"id": n, "no": z}), "f": K.xmlforest(t=t, n=n, z=z), "c": K.xmlconcat(K.xmlelement("t", t), K.xmlelement("b")), "cm": K.xmlcomment("hi"), "w": K.xml_is_well_formed(F.lit("<a/>x")), "wd": K.xml_is_well_formed_document(F.lit("<a/>x")), "x": K.xpath(doc, "/r/a/text()"), "ex": K.xmlexists(doc, "/r/a[text()='y']"), "p": K.xmlparse(F.lit("<a>ok</a>"))}


@query("fn_xmlagg", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_nationkey) AS x FROM nation GROUP BY n_regionkey")
def xmlagg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(K.xmlagg(K.xmlelement("n", c("n_name")), c("n_nationkey")).alias("x"))


@query("fn_table_to_xml", "SELECT '<region>' || string_agg('<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></row>', '' ORDER BY r_regionkey) || '</region>' AS xml FROM region")
def table_to_xml(spark, d):
    return K.table_to_xml(table(spark, d, "region").select("r_regionkey", "r_name"), "region")


@query("fn_session", expect("s, m, t, v, b, n", ("on", None, "int", True, False, 3)))
def session(spark, d):
    K.set_config(spark, "tessella.test", "on")
    f = F.lit
    return spark.range(1).select(K.current_setting(spark, "tessella.test").alias("s"), K.current_setting(spark, "tessella.none", True).cast("string").alias("m"), K.value_type(f(1)).alias("t"), K.input_is_valid(f("42"), "int").alias("v"), K.input_is_valid(f("4x"), "int").alias("b"), K.column_size(f("abc")).alias("n"))


@query("fn_sequence", "SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS v FROM orders")
def nextval(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return K.sequence_values(o, "v", ["o_orderdate", "o_orderkey"], 100, 5).select("o_orderkey", "v")
