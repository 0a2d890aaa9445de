"""Arrays, on inputs where the dialect and Spark differ."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import arrays as A
from tessella.plans.registry import cases, expect

c = F.col
P = "SELECT p_partkey, transform(split(p_name, ''), x -> ascii(x) % 7) AS a, sequence(1, p_size % 6 + 1) AS b FROM part"
SQL_P = "(SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ascii(x) % 7) AS a, generate_series(1, (p_size % 6 + 1)::BIGINT) AS b FROM part)"
INTS, DEEP = T.ArrayType(T.IntegerType()), T.ArrayType(T.ArrayType(T.IntegerType()))


@cases("fn_arr_search", P, f"SELECT p_partkey, list_position(a, 3)::INT AS p, list_filter(generate_series(1, len(a)), lambda i: a[i] = 3) AS ps, list_transform(a, lambda x: CASE WHEN x = 3 THEN 9 ELSE x END) AS r, list_filter(a, lambda x: x <> 3) AS d, list_reverse(a) AS v, a[1:len(a) - 2] AS t, a[2:4] AS s FROM {SQL_P}")
def _():
    a = c("a")
    return {"p_partkey": c("p_partkey"), "p": A.array_position(a, 3), "ps": A.array_positions(a, 3), "r": A.array_replace(a, 3, 9), "d": A.array_remove(a, 3), "v": A.array_reverse(a), "t": A.trim_array(a, 2), "s": A.array_slice(a, 2, 4)}


@cases("fn_arr_operators", P, f"SELECT p_partkey, list_has_all(a, b) AS c, list_has_all(b, a) AS d, list_has_any(a, b) AS o, a < list_transform(b, lambda x: x::INT) AS l, a || list_transform(b, lambda x: x::INT) AS cat, list_append(a, 1) AS ap, list_prepend(1, a) AS pp, list_sort(a) AS srt, list_reverse(list_sort(a)) AS dsc FROM {SQL_P}")
def _():
    a, b = c("a"), c("b")
    return {"p_partkey": c("p_partkey"), "c": A.contains(a, b), "d": A.contained(a, b), "o": A.overlap(a, b), "l": A.less(a, b), "cat": A.array_cat(a, b), "ap": A.array_append(a, 1), "pp": A.array_prepend(1, a), "srt": A.array_sort(a), "dsc": A.array_sort(a, True)}


@cases("fn_arr_subscripts", P, f"SELECT p_partkey, unnest(generate_series(1, len(a)))::INT AS i FROM {SQL_P}")
def _():
    return {"p_partkey": c("p_partkey"), "i": A.generate_subscripts(c("a"))}


@cases("fn_arr_shape", "SELECT array(array(1, 2, 3), array(4, 5, 6)) AS d, array(1, NULL, 2, NULL) AS n, CAST(array() AS array<int>) AS e", expect("dims, nd, l, u, lo, card, empty_len, empty_dims, fill, nulls, gone, cat, js", ("[1:2][1:3]", 2, 2, 3, 1, 6, None, None, "[[7,7],[7,7],[7,7]]", [2, 4], [1, 2], "[1,null,2,null]", "[[1,2,3],[4,5,6]]")))
def _():
    d, n, e = c("d"), c("n"), c("e")
    return {
        "dims": A.array_dims(d, DEEP), "nd": A.array_ndims(d, DEEP), "l": A.array_length(d), "u": A.array_upper(d, 2), "lo": A.array_lower(d), "card": A.cardinality(d, DEEP), "empty_len": A.array_length(e), "empty_dims": A.array_dims(e, INTS),
        "fill": F.to_json(A.array_fill(7, [3, 2])), "nulls": A.array_positions(n, None), "gone": A.array_remove(n, None), "cat": F.to_json(A.array_cat(n, F.lit(None).cast("array<int>"))), "js": F.to_json(d),
    }


@cases("fn_arr_random", P, f"SELECT p_partkey, true AS same, least(len(a), 3)::INT AS n, true AS within FROM {SQL_P}")
def _():
    a = c("a")
    s = A.array_sample(a, 3, 5, c("p_partkey"))
    return {"p_partkey": c("p_partkey"), "same": F.array_sort(A.array_shuffle(a, 5, c("p_partkey"))) == F.array_sort(a), "n": F.size(s), "within": A.contains(a, s)}


@cases("fn_intarray", "SELECT array(3, 1, 1, 2) AS a, array(2, 5) AS b", expect("s, u, un, i, d, x, q, z", ([1, 1, 2, 3], [1, 2, 3], [1, 2, 3, 5], [2], [1, 3], 4, True, False)))
def _():
    a, b = c("a"), c("b")
    return {"s": A.int_sort(a), "u": A.int_uniq(A.int_sort(a)), "un": A.int_union(a, b), "i": A.int_intersection(a, b), "d": A.int_difference(a, b), "x": A.int_index(a, 2), "q": A.int_query(a, "1&(5|!7)"), "z": A.int_query(a, "1&5")}
