"""Numbers, on inputs where the dialect and Spark differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numbers as N
from tessella.plans.registry import cases, expect

P = "SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS double) / 51 AS x FROM part"
c = F.col


@cases("fn_num_rounding", P, "SELECT p_partkey, trunc(-p_retailprice) AS t, trunc((p_retailprice * 10)) / 10 AS t1, round_even(p_retailprice, 0) AS e, abs(-p_size)::INT AS a, ceil(-p_retailprice)::BIGINT AS c, round(p_retailprice::DECIMAL(12,2), 1)::DOUBLE AS r FROM part")
def _():
    v = c("p_retailprice")
    return {"p_partkey": c("p_partkey"), "t": N.trunc(-v), "t1": N.trunc(v, 1), "e": N.round_half_even(v), "a": F.abs(-c("p_size")), "c": F.ceiling(-v), "r": N.round_half_away(v.cast("decimal(12,2)"), 1).cast("double")}


@cases("fn_num_ties", "SELECT * FROM VALUES (0.5D), (1.5D), (2.5D), (-2.5D) AS t(x)", expect("x, even, away, td", (0.5, 0.0, 1.0, 0), (1.5, 2.0, 2.0, 1), (2.5, 2.0, 3.0, 2), (-2.5, -2.0, -3.0, -2)))
def _():
    d = c("x").cast("decimal(5,1)")
    return {"x": c("x"), "even": N.round_half_even(c("x")), "away": N.round_half_away(d).cast("double"), "td": N.trunc_decimal(d).cast("long")}


@cases("fn_num_divisors", P, "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS g, lcm(p_partkey, p_size)::BIGINT AS l, gcd(0, p_size)::BIGINT AS z, lcm(0, p_size)::BIGINT AS lz, factorial(p_size % 20)::BIGINT AS f FROM part")
def _():
    return {"p_partkey": c("p_partkey"), "g": N.gcd(c("p_partkey"), c("p_size")), "l": N.lcm(c("p_partkey"), c("p_size")), "z": N.gcd(0, c("p_size")), "lz": N.lcm(0, c("p_size")), "f": F.factorial(c("p_size") % 20)}


@cases("fn_num_logs", P, "SELECT p_partkey, log10(p_size) AS l, log10(p_size) AS l10, round(log(2, p_size), 9) AS l2, pi() AS pi, round(exp(ln(p_size)), 9) AS e, p_size ** 0.5 AS s FROM part")
def _():
    s = c("p_size").cast("double")
    return {"p_partkey": c("p_partkey"), "l": N.log(s), "l10": F.log10(s), "l2": F.round(N.log(s, 2.0), 9), "pi": F.pi(), "e": F.round(F.exp(F.ln(s)), 9), "s": F.power(s, F.lit(0.5))}


@cases("fn_num_trig", P, "SELECT p_partkey, " + ", ".join(f"round({f}(x), 9) AS {f}" for f in ("tan", "cot", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")) + ", round(acosh(x + 1), 9) AS acosh FROM (SELECT p_partkey, p_size / 51.0::DOUBLE AS x FROM part)")
def _():
    x = c("x")
    return {"p_partkey": c("p_partkey"), **{f: F.round(getattr(F, f)(x), 9) for f in ("tan", "cot", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")}, "acosh": F.round(F.acosh(x + 1), 9)}


@cases("fn_num_degrees", "SELECT CAST(30 * id AS double) AS x FROM range(13)", "SELECT x, round(sin(radians(x)), 9) + 0.0 AS s, round(cos(radians(x)), 9) + 0.0 AS c, CASE WHEN x % 180 <> 90 THEN round(tan(radians(x)), 9) + 0.0 END AS t, 45.0::DOUBLE AS one FROM (SELECT (30 * range)::DOUBLE AS x FROM range(13))")
def _():
    x = c("x")
    return {"x": x, "s": F.round(N.sind(x), 9) + 0.0, "c": F.round(N.cosd(x), 9) + 0.0, "t": F.when(x % 180 != 90, F.round(N.tand(x), 9) + 0.0), "one": N.atand(N.tand(F.lit(45.0)))}


@cases("fn_num_exact_degrees", "SELECT 1", expect("a, b, d, e, f, g, h, i", (0.5, 0.5, 1.0, 1.0, 30.0, 60.0, 45.0, 120.0)))
def _():
    v = F.lit
    return {"a": N.sind(v(30.0)), "b": N.cosd(v(60.0)), "d": N.tand(v(45.0)), "e": N.cotd(v(45.0)), "f": N.asind(v(0.5)), "g": N.acosd(v(0.5)), "h": N.atan2d(v(1.0), v(1.0)), "i": N.acosd(v(-0.5))}


@cases("fn_num_special", "SELECT * FROM VALUES (0.5D), (1D), (4.5D) AS t(x)", expect("x, e, ec, g, l", (0.5, 0.520499878, 0.479500122, 1.772453851, 0.572364943), (1.0, 0.842700793, 0.157299207, 1.0, 0.0), (4.5, 1.0, 0.0, 11.631728397, 2.453736571)))
def _():
    return {"x": c("x"), **{k: F.round(f(c("x")), 9) for k, f in (("e", N.erf), ("ec", N.erfc), ("g", N.gamma), ("l", N.lgamma))}}


@cases("fn_num_scale", "SELECT * FROM VALUES (CAST(8.4100 AS decimal(10,4)), 1), (CAST(8 AS decimal(10,4)), 2), (CAST(-0.05 AS decimal(10,4)), 3) AS t(x, k)", expect("k, s, m, t", (1, 4, 2, "8.41"), (2, 4, 0, "8"), (3, 4, 2, "-0.05")))
def _():
    return {"k": c("k"), "s": N.scale(c("x")), "m": N.min_scale(c("x")), "t": N.trim_scale(c("x"))}


@cases("fn_num_buckets", P, "SELECT p_partkey, (p_retailprice >= 1000)::INT + (p_retailprice >= 1200)::INT + (p_retailprice >= 1500)::INT AS b FROM part")
def _():
    return {"p_partkey": c("p_partkey"), "b": N.width_bucket(c("p_retailprice"), [1000.0, 1200.0, 1500.0])}


@cases("fn_num_random", "SELECT 1", expect("u, n, b, same", (True, True, True, True)))
def _():
    ids = F.sequence(F.lit(1), F.lit(20_000))
    mean = lambda f: F.aggregate(F.transform(ids, f), F.lit(0.0), lambda a, x: a + x) / 20_000
    b = F.transform(ids, lambda i: N.random_between(7, 3, 9, i))
    return {
        "u": F.abs(mean(lambda i: N.random(7, i)) - 0.5) < 0.01,
        "n": (F.abs(mean(lambda i: N.random_normal(7, i, mean=5.0)) - 5) < 0.03) & (F.abs(mean(lambda i: F.pow(N.random_normal(7, i), 2.0)) - 1) < 0.05),
        "b": (F.array_min(b) == 3) & (F.array_max(b) == 9),
        "same": N.random(3, F.lit(5)) == N.random(3, F.lit(5)),
    }


@cases("fn_num_sizes", "SELECT * FROM VALUES ('10 bytes'), ('1.5 kB'), ('20 MB'), ('-3 GB') AS t(s)", expect("s, n, p", ("10 bytes", 10, "10 bytes"), ("1.5 kB", 1536, "1536 bytes"), ("20 MB", 20971520, "20 MB"), ("-3 GB", -3221225472, "-3072 MB")))
def _():
    n = N.size_bytes(c("s"))
    return {"s": c("s"), "n": n, "p": N.size_pretty(n)}
