"""Scalar functions: text, pattern, number, date and array expressions."""

from __future__ import annotations

from tessella.plans.registry import statement

P, O, E = "FROM part", "FROM orders", "FROM events"

# text
statement("str_case", f"SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, initcap(p_name) AS i {P}", f"SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS i {P}")
statement("str_lengths", f"SELECT p_partkey, char_length(p_name) AS c, octet_length(p_name) AS o, bit_length(p_name) AS b {P}", f"SELECT p_partkey, length(p_name)::INT AS c, strlen(p_name)::INT AS o, (strlen(p_name) * 8)::INT AS b {P}")
statement("str_substring", f"SELECT p_partkey, substring(p_name, 2, 4) AS s, left(p_name, 3) AS l, right(p_name, 3) AS r {P}")
statement("str_pad", f"SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r {P}")
statement("str_trim", "SELECT btrim('xxabxx', 'x') AS b, ltrim('x', 'xxab') AS l, rtrim('x', 'abxx') AS r", "SELECT trim('xxabxx', 'x') AS b, ltrim('xxab', 'x') AS l, rtrim('abxx', 'x') AS r")
statement("str_position", f"SELECT p_partkey, position('e' IN p_name) AS p, instr(p_type, 'A') AS i {P}", f"SELECT p_partkey, position('e' IN p_name)::INT AS p, instr(p_type, 'A')::INT AS i {P}")
statement("str_replace", f"SELECT p_partkey, replace(p_name, 'e', '3') AS r, translate(p_name, 'aeiou', '12345') AS t, reverse(p_brand) AS v {P}")
statement("str_overlay", "SELECT overlay('abcdef' PLACING 'ZZ' FROM 3 FOR 2) AS o", "SELECT left('abcdef', 2) || 'ZZ' || substr('abcdef', 5) AS o")
statement("str_split_part", f"SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, split_part(o_orderpriority, '-', 2) AS b {O}")
statement("str_concat", f"SELECT p_partkey, concat_ws('|', p_brand, NULL, p_type) AS w, p_brand || p_type AS c, repeat(p_brand, 2) AS r {P}")
statement("str_ascii_chr", f"SELECT p_partkey, ascii(p_name) AS a, chr(65 + p_partkey % 26) AS c {P}", f"SELECT p_partkey, ascii(p_name)::INT AS a, chr((65 + p_partkey % 26)::INT) AS c {P}")
statement("str_md5_sha", f"SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s {P}", f"SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s {P}")
statement("str_hex_base64", f"SELECT p_partkey, lower(hex(p_name)) AS h, base64(CAST(p_brand AS binary)) AS b {P}", f"SELECT p_partkey, lower(hex(p_name)) AS h, base64(encode(p_brand)) AS b {P}")
statement("str_levenshtein", f"SELECT p_partkey, levenshtein(p_name, p_type) AS d, levenshtein(p_brand, 'Brand#11') AS b {P}", f"SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d, levenshtein(p_brand, 'Brand#11')::INT AS b {P}")
statement("str_starts_ends", f"SELECT p_partkey, startswith(p_name, 'b') AS s, endswith(p_name, 'n') AS e, contains(p_name, 'ee') AS c {P}", f"SELECT p_partkey, starts_with(p_name, 'b') AS s, suffix(p_name, 'n') AS e, contains(p_name, 'ee') AS c {P}")

# patterns
statement("re_replace", f"SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_') AS r {P}", f"SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS r {P}")
statement("re_extract", f"SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS d, regexp_extract_all(p_name, '[a-z]e', 0) AS l {P}", f"SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS d, regexp_extract_all(p_name, '[a-z]e') AS l {P}")
statement("re_split_count", f"SELECT p_partkey, split(p_type, '[ ]+') AS s, regexp_count(p_name, '[aeiou]') AS n {P}", f"SELECT p_partkey, string_split_regex(p_type, '[ ]+') AS s, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n {P}")

# numbers
statement("num_rounding", f"SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, sign(p_size - 25) AS s {P}", f"SELECT p_partkey, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, sign(p_size - 25)::DOUBLE AS s {P}")
statement("num_powers", f"SELECT p_partkey, sqrt(p_size) AS q, cbrt(p_size) AS c, power(p_size, 2) AS p, exp(p_size / 50D) AS e, ln(p_size) AS l {P}", f"SELECT p_partkey, sqrt(p_size) AS q, cbrt(p_size) AS c, power(p_size, 2) AS p, exp(p_size / 50.0) AS e, ln(p_size) AS l {P}")
statement("num_trig", f"SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, atan2(p_size, 3D) AS a, radians(p_size) AS r, degrees(p_size / 10D) AS d {P}", f"SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, atan2(p_size, 3.0) AS a, radians(p_size) AS r, degrees(p_size / 10.0) AS d {P}")
statement("num_integer", f"SELECT p_partkey, p_partkey % 7 AS m, p_size div 3 AS q, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l {P}", f"SELECT p_partkey, p_partkey % 7 AS m, (p_size // 3)::BIGINT AS q, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS l {P}")
statement("num_width_bucket", f"SELECT o_orderkey, width_bucket(o_totalprice, 0D, 500000D, 10) AS b {O}", f"SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END::BIGINT AS b {O}")
statement("num_gcd_factorial", "SELECT factorial(10) AS f, greatest(3, NULL, 7) AS g, least(3, NULL, 7) AS l", "SELECT factorial(10)::BIGINT AS f, greatest(3, NULL, 7) AS g, least(3, NULL, 7) AS l")

# dates
statement("date_parts", f"SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w {O}", f"SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS dy, weekofyear(o_orderdate)::INT AS w {O}")
statement("date_trunc_month", f"SELECT CAST(trunc(o_orderdate, 'MM') AS date) AS m, count(*) AS n {O} GROUP BY 1", f"SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n {O} GROUP BY 1")
statement("date_arithmetic", f"SELECT o_orderkey, CAST(o_orderdate AS date) + INTERVAL 10 DAYS AS d, add_months(o_orderdate, 2) AS a, last_day(o_orderdate) AS l {O}", f"SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 10 DAYS)::DATE AS d, (o_orderdate::DATE + INTERVAL 2 MONTHS)::DATE AS a, last_day(o_orderdate) AS l {O}")
statement("date_difference", f"SELECT o_orderkey, datediff(CAST(o_orderdate AS date), DATE '1995-01-01') AS d {O}", f"SELECT o_orderkey, (o_orderdate::DATE - DATE '1995-01-01')::INT AS d {O}")
statement("date_format", f"SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS f, make_date(year(o_orderdate), 1, 1) AS m {O}", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, make_date(year(o_orderdate), 1, 1) AS m {O}")

# conditions
statement("cond_coalesce", "SELECT v, coalesce(v, 0) AS c, nullif(v, 2) AS n, nvl2(v, 1, 0) AS h FROM (VALUES (1), (2), (NULL)) t(v)", "SELECT v, coalesce(v, 0) AS c, nullif(v, 2) AS n, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS h FROM (VALUES (1), (2), (NULL)) t(v)")
statement("cast_types", f"SELECT p_partkey, CAST(p_size AS string) AS s, CAST(p_retailprice AS decimal(12,2)) AS d, CAST(p_size AS double) AS f, try_cast(p_name AS int) AS t {P}", f"SELECT p_partkey, p_size::VARCHAR AS s, p_retailprice::DECIMAL(12,2) AS d, p_size::DOUBLE AS f, try_cast(p_name AS INT) AS t {P}")

# arrays
A = "FROM (SELECT array(3, 1, 2, 1) AS a, array(1, 5) AS b)"
B = "FROM (SELECT [3, 1, 2, 1] AS a, [1, 5] AS b)"
statement("arr_basics", f"SELECT size(a) AS n, element_at(a, 1) AS f, array_position(a, 1) AS p, array_append(a, 9) AS ap, array_prepend(a, 0) AS pp, concat(a, b) AS c {A}", f"SELECT len(a)::INT AS n, a[1] AS f, list_position(a, 1)::BIGINT AS p, list_append(a, 9) AS ap, list_prepend(0, a) AS pp, a || b AS c {B}")
statement("arr_sets", f"SELECT array_remove(a, 1) AS r, array_contains(a, 2) AS c, arrays_overlap(a, b) AS o, sort_array(a) AS s, slice(a, 2, 2) AS l, array_max(a) AS m {A}", f"SELECT list_filter(a, lambda x: x <> 1) AS r, list_contains(a, 2) AS c, list_has_any(a, b) AS o, list_sort(a) AS s, a[2:3] AS l, list_max(a) AS m {B}")
statement("arr_lambda", f"SELECT transform(a, x -> x * 2) AS t, filter(a, x -> x > 1) AS f, aggregate(a, 0, (s, x) -> s + x) AS g {A}", f"SELECT list_transform(a, lambda x: x * 2) AS t, list_filter(a, lambda x: x > 1) AS f, list_sum(a)::INT AS g {B}")
statement("arr_string", f"SELECT p_partkey, array_join(sort_array(split(p_name, ' ')), ',') AS j {P}", f"SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS j {P}")

# json
statement("json_extract", f"SELECT event_id, CAST(get_json_object(props, '$.k') AS int) AS k {E}", f"SELECT event_id, (props->>'$.k')::INT AS k {E}")
statement("json_group", f"SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS bigint)) AS s {E} GROUP BY event_type", f"SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS s {E} GROUP BY event_type")
statement("json_keys", f"SELECT event_id, json_object_keys(props) AS k, json_array_length('[1,2,3]') AS n {E}", f"SELECT event_id, json_keys(props) AS k, 3 AS n {E}")

# vectors
V = "FROM (SELECT vec_id, embedding FROM embeddings) a CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) b"
statement("vec_l2", f"SELECT vec_id, round(sqrt(aggregate(zip_with(embedding, q, (x, y) -> CAST(x AS double) - y), 0D, (s, d) -> s + d * d)), 5) AS d {V}", f"SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) ** 2))), 5) AS d {V}")
statement("vec_inner", f"SELECT vec_id, round(aggregate(zip_with(embedding, q, (x, y) -> CAST(x AS double) * y), 0D, (s, d) -> s + d), 5) AS d {V}", f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2])), 5) AS d {V}")
statement("vec_dims_norm", "SELECT vec_id, size(embedding) AS n, round(sqrt(aggregate(embedding, 0D, (s, x) -> s + CAST(x AS double) * x)), 5) AS l FROM embeddings", "SELECT vec_id, len(embedding)::INT AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS l FROM embeddings")

# catalogue of approximate aggregates, held against exact counts elsewhere
# the two counts apart: side by side, every distinct value would carry a sketch of its own through the exchange
statement("approx_distinct_lineitem", "SELECT abs(a - x) <= 0.05 * x AS close FROM (SELECT approx_count_distinct(l_partkey, 0.01) AS a FROM lineitem) CROSS JOIN (SELECT count(DISTINCT l_partkey) AS x FROM lineitem)", "SELECT true AS close")
statement("approx_percentile_price", "SELECT abs(percentile_approx(o_totalprice, 0.5, 10000) - median(o_totalprice)) <= 0.01 * median(o_totalprice) AS close FROM orders", "SELECT true AS close")
