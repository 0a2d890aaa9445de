"""Key-value texts, label trees, trigrams, cubes, enumerations, UUIDs, log positions, XML, money and session settings."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tessella.functions.base import BINARY, BOOL, INT, STRING, col, rowwise
from tessella.session import materialize

# -- key-value maps: map<string,string> columns -------------------------------------------------

_PAIR = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^\s,=]+)\s*=>\s*("(?:[^"\\]|\\.)*"|[^\s,]+)\s*(?:,|$)')


def _hstore(s: str) -> dict:
    plain = lambda t: re.sub(r"\\(.)", r"\1", t[1:-1]) if t[:1] == '"' else t
    out: dict = {}
    for k, v in _PAIR.findall(s):
        out.setdefault(plain(k), None if v.upper() == "NULL" else plain(v))
    return out


hstore = rowwise(_hstore, T.MapType(STRING, STRING))


def hstore_text(m: Column) -> Column:
    """Keys by length, then by bytes."""
    q = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(q(r["k"]), F.lit("=>"), F.coalesce(q(r["v"]), F.lit("NULL")))), ", ")


def h_get(m: Column, key) -> Column:
    return F.try_element_at(m, col(key))


def h_exists(m: Column, key) -> Column:
    return F.map_contains_key(m, col(key))


def h_exists_all(m: Column, keys: list[str]) -> Column:
    return F.forall(F.lit(keys), lambda k: F.array_contains(F.map_keys(m), k))


def h_exists_any(m: Column, keys: list[str]) -> Column:
    return F.exists(F.lit(keys), lambda k: F.array_contains(F.map_keys(m), k))


def h_concat(a: Column, b: Column) -> Column:
    """The right side counts for a key of both."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def h_delete(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def h_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.array_contains(F.map_keys(a), e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def h_slice(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def h_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


# -- label trees: texts such as Top.Science.Astronomy -------------------------------------------


def nlevel(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\.")))


def subpath(t: Column, offset: int, count: int | None = None) -> Column:
    a = F.split(t, r"\.")
    first = F.lit(offset + 1) if offset >= 0 else F.greatest(F.size(a) + offset + 1, F.lit(1))
    n = F.size(a) - first + 1 if count is None else F.lit(count) if count >= 0 else F.greatest(F.size(a) + count - first + 1, F.lit(0))
    return F.array_join(F.slice(a, first, n), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b, itself included."""
    return (a == b) | (a == "") | F.startswith(b, F.concat(a, F.lit(".")))


def lca(*trees: Column) -> Column:
    """The longest path above all of them."""
    parts = [F.slice(F.split(t, r"\."), F.lit(1), F.size(F.split(t, r"\.")) - 1) for t in trees]
    n = F.least(*[F.size(p) for p in parts]) if len(parts) > 1 else F.size(parts[0])
    same = lambda i: F.lit(True) if len(parts) == 1 else _all_equal([F.get(p, i) for p in parts])
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~same(i))
    return F.array_join(F.slice(parts[0], F.lit(1), F.array_min(differs)), ".")


def _all_equal(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols[1:]:
        out = out & c.eqNullSafe(cols[0])
    return out


def lquery(pattern: str) -> str:
    """The regular expression of a label query: ``*{1,2}.astro*@%|foo.!bar``."""
    out = []
    for i, item in enumerate(pattern.split(".")):
        m = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item)
        if m:
            lo, hi = (m[1] or "0", m[3] if m[2] else m[1]) if m[1] or m[3] else ("0", "")
            out.append(("STAR", lo or "0", hi))
            continue
        no, item = (True, item[1:]) if item.startswith("!") else (False, item)
        alts = []
        for a in item.split("|"):
            flags = re.search(r"[@*%]*$", a)[0]
            word = re.escape(a[: len(a) - len(flags)])
            word += r"\w*" if "*" in flags else ""
            alts.append(f"(?i:{word})" if "@" in flags else word)
        one = "(?:" + "|".join(alts) + ")"
        out.append(("LABEL", rf"(?!{one}(?:\.|$))[\w-]+" if no else one, ""))
    rx = "^"
    for what, a, b in out:
        rx += rf"(?:(?:^|\.)[\w-]+){{{a},{b}}}" if what == "STAR" else rf"(?:^|\.){a}(?=\.|$)"
    return rx + "$"


def matches(t: Column, pattern: str) -> Column:
    """t ~ pattern."""
    return t.rlike(lquery(pattern))


# -- trigrams -----------------------------------------------------------------------------------


def show_trgm(s: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def similarity(a: Column, b: Column) -> Column:
    x, y = show_trgm(a), show_trgm(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(F.array_union(x, y)) == 0, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def _word_similarity(a: str, b: str) -> float:
    grams = lambda s: [w2[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for w2 in (f"  {w} ",) for i in range(len(w2) - 2)]
    x, y = set(grams(a)), grams(b)
    best = 0.0
    at = [i for i, g in enumerate(y) if g in x]
    for n, i in enumerate(at):
        seen: set = set()
        for j in at[n:]:
            seen = set(y[i : j + 1])
            both = len(seen & x)
            best = max(best, both / (len(x) + len(seen) - both))
    return best


word_similarity = rowwise(_word_similarity, T.DoubleType())


def similar(a: Column, b: Column, least: float = 0.3) -> Column:
    """a % b."""
    return similarity(a, b) >= least


# -- cubes: arrays of doubles for each corner ---------------------------------------------------


def cube(a: Column, b: Column | None = None) -> Column:
    b = a if b is None else b
    return F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), F.transform(b, lambda x: x.cast("double")).alias("b"))


def _edges(c: Column) -> tuple[Column, Column]:
    return F.zip_with(c["a"], c["b"], lambda x, y: F.least(x, y)), F.zip_with(c["a"], c["b"], lambda x, y: F.greatest(x, y))


def cube_dim(c: Column) -> Column:
    return F.size(c["a"])


def cube_size(c: Column) -> Column:
    lo, hi = _edges(c)
    return F.aggregate(F.zip_with(lo, hi, lambda x, y: y - x), F.lit(1.0), lambda acc, x: acc * x)


def cube_distance(c: Column, d: Column) -> Column:
    """Between the nearest points."""
    (l1, h1), (l2, h2) = _edges(c), _edges(d)
    gap = F.zip_with(F.zip_with(l1, h2, lambda x, y: x - y), F.zip_with(l2, h1, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x * x))


def cube_contains(c: Column, d: Column) -> Column:
    (l1, h1), (l2, h2) = _edges(c), _edges(d)
    return F.forall(F.zip_with(l1, l2, lambda x, y: x <= y), lambda x: x) & F.forall(F.zip_with(h1, h2, lambda x, y: x >= y), lambda x: x)


def cube_overlap(c: Column, d: Column) -> Column:
    return cube_distance(c, d) == 0


def cube_union(c: Column, d: Column) -> Column:
    (l1, h1), (l2, h2) = _edges(c), _edges(d)
    return F.struct(F.zip_with(l1, l2, lambda x, y: F.least(x, y)).alias("a"), F.zip_with(h1, h2, lambda x, y: F.greatest(x, y)).alias("b"))


def cube_enlarge(c: Column, r: float) -> Column:
    lo, hi = _edges(c)
    return F.struct(F.transform(lo, lambda x: x - r).alias("a"), F.transform(hi, lambda x: x + r).alias("b"))


def earth_distance(lat1, lon1, lat2, lon2, r: float = 6378168.0) -> Column:
    """Along the great circle."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), F.lit(2.0))
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * r)


# -- enumerations -------------------------------------------------------------------------------


class Enum:
    """Labels in an order of their own."""

    def __init__(self, *labels: str) -> None:
        self.labels = labels

    def first(self) -> Column:
        return F.lit(self.labels[0])

    def last(self) -> Column:
        return F.lit(self.labels[-1])

    def range(self, low: str | None = None, high: str | None = None) -> Column:
        a = 0 if low is None else self.labels.index(low)
        b = len(self.labels) if high is None else self.labels.index(high) + 1
        return F.lit(list(self.labels[a:b]))

    def order(self, c: Column) -> Column:
        """Sorts and compares as the labels do; an error for others."""
        at = F.array_position(F.lit(list(self.labels)), c)
        return F.when(at > 0, at).when(c.isNotNull(), F.raise_error(F.concat(F.lit("invalid input value for enum: "), c)).cast("long"))


# -- UUIDs --------------------------------------------------------------------------------------

uuid_extract_version = rowwise(lambda s: uuid.UUID(s).version if uuid.UUID(s).variant == uuid.RFC_4122 else None, INT)


def _uuid_time(s: str):
    u = uuid.UUID(s)
    if u.version == 7:
        return (u.int >> 80) * 1000
    if u.version == 1:
        return (u.time - 0x01B21DD213814000) // 10
    return None


uuid_extract_micros = rowwise(_uuid_time, T.LongType())


def uuid_extract_timestamp(u: Column) -> Column:
    """Of versions 1 and 7."""
    return F.timestamp_micros(uuid_extract_micros(u))


def gen_random_uuid(seed: int, *key: Column) -> Column:
    """Version 4 from a hash of seed and key, so that reruns agree."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    v = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda i, n: F.substring(h, i, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), v, part(18, 3), F.lit("-"), part(21, 12))


def uuidv7(at: Column, seed: int, *key: Column) -> Column:
    """Version 7 of a moment; the rest by hash."""
    ms = F.lower(F.lpad(F.hex(F.unix_millis(at.cast("timestamp"))), 12, "0"))
    r = gen_random_uuid(seed, *key)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(r, F.lit(16), F.lit(21)))


uuid_v3 = rowwise(lambda ns, name: str(uuid.uuid3(uuid.UUID(ns), name)), STRING)
uuid_v5 = rowwise(lambda ns, name: str(uuid.uuid5(uuid.UUID(ns), name)), STRING)

# -- digests ------------------------------------------------------------------------------------

digest = rowwise(lambda b, how: hashlib.new(how, bytes(b)).digest(), BINARY)
hmac = rowwise(lambda b, key, how: _hmac.new(bytes(key), bytes(b), how).digest(), BINARY)

# -- log positions ------------------------------------------------------------------------------


def lsn(s: Column) -> Column:
    """The number of a position such as 16/B374D848."""
    return F.conv(F.split_part(s, F.lit("/"), F.lit(1)), 16, 10).cast("long") * F.lit(1 << 32) + F.conv(F.split_part(s, F.lit("/"), F.lit(2)), 16, 10).cast("long")


def lsn_text(n: Column) -> Column:
    return F.concat(F.hex(F.floor(n / F.lit(1 << 32)).cast("long")), F.lit("/"), F.hex(F.pmod(n, F.lit(1 << 32))))


# -- XML ----------------------------------------------------------------------------------------


def xml_escape(s: Column, attribute: bool = False) -> Column:
    out = s.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xmlelement(name: str, *content, attributes: dict[str, Column] | None = None) -> Column:
    """Content is text to be escaped, or what ``xml`` marks as it is."""
    attrs = [F.when(col(v).isNotNull(), F.concat(F.lit(f' {k}="'), xml_escape(col(v), True), F.lit('"'))) for k, v in (attributes or {}).items()]
    inner = F.concat_ws("", *[c.c if isinstance(c, Xml) else xml_escape(col(c)) for c in content]) if content else F.lit("")
    head = F.concat_ws("", F.lit(f"<{name}"), *attrs)
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>")))


class Xml:
    """A column that is XML already."""

    def __init__(self, c: Column) -> None:
        self.c = c


def xmlforest(**cols) -> Column:
    """An element for each that isn't null."""
    return F.concat_ws("", *[F.when(col(v).isNotNull(), xmlelement(k, v)) for k, v in cols.items()])


def xmlconcat(*cols) -> Column:
    return F.concat_ws("", *cols)


def xmlcomment(s) -> Column:
    return F.concat(F.lit("<!--"), col(s), F.lit("-->"))


def xmlagg(x: Column, *by: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], x.alias("x"))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), ""))


def _well_formed(s: str, document: bool) -> bool:
    import xml.etree.ElementTree as E

    try:
        E.fromstring(s if document else f"<x>{s}</x>")
        return True
    except E.ParseError:
        return False


xml_is_well_formed = rowwise(lambda s: _well_formed(s, False), BOOL)
xml_is_well_formed_document = rowwise(lambda s: _well_formed(s, True), BOOL)


def xmlparse(s: Column, document: bool = True) -> Column:
    ok = xml_is_well_formed_document(s) if document else xml_is_well_formed(s)
    return F.when(ok, s).when(s.isNotNull(), F.raise_error(F.lit("invalid XML")).cast("string"))


def xpath(s: Column, path: str) -> Column:
    """Texts that a path finds."""
    return F.xpath(s, F.lit(path))


def xmlexists(s: Column, path: str) -> Column:
    return F.xpath_boolean(s, F.lit(path))


def table_to_xml(df, name: str):
    """One row: the table as a document, its rows in order of their columns."""
    fields = {c: F.col(f"`{c}`") for c in df.columns}
    row = F.concat(F.lit("<row>"), xmlforest(**fields), F.lit("</row>"))
    return df.select(row.alias("x"), *[c.alias(f"k{i}") for i, c in enumerate(fields.values())]).agg(F.concat(F.lit(f"<{name}>"), F.coalesce(xmlagg(F.col("x"), *[F.col(f"k{i}") for i in range(len(fields))]), F.lit("")), F.lit(f"</{name}>")).alias("xml"))


# -- money --------------------------------------------------------------------------------------


def money_text(x: Column) -> Column:
    """Like -$1,234.50."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(x), 2))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _words(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f" {_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" {_words(n % 100)}" if n % 100 else "")
    for size, name in ((10**15, "quadrillion"), (10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            return f"{_words(n // size)} {name}" + (f" {_words(n % size)}" if n % size else "")
    return ""


def _cash_words(x) -> str:
    cents = round(abs(x) * 100)
    whole, part = divmod(int(cents), 100)
    text = f"{'minus ' if x < 0 else ''}{_words(whole)} dollar{'' if whole == 1 else 's'} and {_words(part)} cent{'' if part == 1 else 's'}"
    return text[0].upper() + text[1:]


cash_words = rowwise(_cash_words, STRING)

# -- bit strings: texts of 0 and 1 --------------------------------------------------------------


def bits_and(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bits_or(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def bits_xor(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: F.when(x != y, "1").otherwise("0"))


def _bits(a: Column, b: Column, f) -> Column:
    each = lambda s: F.regexp_extract_all(s, F.lit("."), F.lit(0))
    same = F.when(F.length(a) == F.length(b), F.array_join(F.zip_with(each(a), each(b), f), ""))
    return F.when(same.isNull() & a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("cannot combine bit strings of different sizes")).cast("string")).otherwise(same)


def bits_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bits_shift(a: Column, n: int) -> Column:
    """To the left; to the right where n is negative. The length stays."""
    z = F.repeat(F.lit("0"), F.lit(abs(n)))
    return F.substring(F.concat(a, z), F.lit(n + 1), F.length(a)) if n >= 0 else F.substring(F.concat(z, a), F.lit(1), F.length(a))


# -- session ------------------------------------------------------------------------------------


def set_config(spark: SparkSession, name: str, value: str) -> Column:
    spark.conf.set(name, value)
    return F.lit(value)


def current_setting(spark: SparkSession, name: str, missing_ok: bool = False) -> Column:
    return F.lit(spark.conf.get(name, None) if missing_ok else spark.conf.get(name))


def value_type(c: Column) -> Column:
    return F.typeof(c)


def input_is_valid(s: Column, kind: str) -> Column:
    """Whether a text can be cast to a type."""
    return F.when(s.isNotNull(), s.try_cast(kind).isNotNull())


def column_size(c: Column) -> Column:
    """Bytes of a value's text or binary form."""
    return F.octet_length(c.cast("string"))


def sequence_values(df, name: str, order: list[str], start: int = 1, increment: int = 1):
    """``df`` with the next values of a sequence, in an order: rows are counted by parts, so no task holds all of them."""
    from pyspark.sql import Window

    part, n = "__part", "__n"
    dealt = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    # written once: where ranges begin is sampled, and both uses must agree on it
    dealt = materialize(dealt.withColumn(n, F.row_number().over(Window.partitionBy(part).orderBy(*order))), "sequence")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return dealt.join(F.broadcast(before), part).withColumn(name, (F.col("__before") + F.col(n) - 1) * increment + start).drop(part, n, "__before")


def hash_values(seed: int, *cols: Column) -> Column:
    """A 64-bit hash of values, arrays or records; not the numbers of another engine."""
    return F.xxhash64(F.lit(seed), *cols)


def random_bytes(n: int, seed: int, *key: Column) -> Column:
    return F.substring(F.unhex(F.concat(*[F.md5(F.concat_ws(":", F.lit(f"{seed}:{i}"), *[k.cast("string") for k in key])) for i in range((n + 15) // 16)])), F.lit(1), F.lit(n))




# -- texts that compare without regard to case, measured intervals, dictionaries ----------------


def citext(s: Column) -> Column:
    """Compares, groups and joins without regard to case."""
    return F.collate(s, "UNICODE_CI")



def _seg(s: str) -> dict:
    s = s.replace("'+-'", "(+-)")
    m = re.match(r"\s*[<>~]?\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)?\s*(\.\.\.?|\(\+-\))?\s*[<>~]?\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)?\s*$", s)
    if not m or (m[1] is None and m[3] is None):
        raise ValueError(f"bad seg representation {s!r}")
    a, b = (float(x) if x else None for x in (m[1], m[3]))
    if m[2] == "(+-)":
        return {"lo": a - b, "hi": a + b}
    if not m[2]:
        return {"lo": a, "hi": a}
    return {"lo": a, "hi": b}


seg = rowwise(_seg, T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))


def seg_overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(a["lo"] <= b["hi"], F.lit(True)) & F.coalesce(b["lo"] <= a["hi"], F.lit(True))


def seg_contains(a: Column, b: Column) -> Column:
    return F.coalesce(a["lo"] <= b["lo"], a["lo"].isNull()) & F.coalesce(a["hi"] >= b["hi"], a["hi"].isNull())


def dict_int(token: Column, most: int = 6, reject_long: bool = False, absolute: bool = False) -> Column:
    """Numbers as lexemes: long ones are cut, or are stop words."""
    t = F.regexp_replace(token, r"^[+-]", "") if absolute else token
    return F.when(F.length(t) <= most, F.array(t)).otherwise(F.array().cast("array<string>") if reject_long else F.array(F.substring(t, 1, most)))


def dict_synonyms(token: Column, table: dict[str, list[str]], keep: bool = True) -> Column:
    """A word's synonyms, itself first where kept; a word without any is left to the next dictionary (null)."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(([k] if keep else []) + v))])
    return F.try_element_at(m, F.lower(token))


def dict_simple(token: Column, stop: list[str], accept: bool = True) -> Column:
    t = F.lower(token)
    return F.when(t.isin(*stop), F.array().cast("array<string>")).when(F.lit(accept), F.array(t))


def dict_affixes(token: Column, words: list[str], suffixes: list[tuple[str, str]]) -> Column:
    """Base forms by rules (ending, what stands for it) that lead to known words."""
    t = F.lower(token)
    forms = F.array(t, *[F.when(F.endswith(t, F.lit(a)), F.concat(F.substring(t, F.lit(1), F.length(t) - len(a)), F.lit(b))) for a, b in suffixes])
    got = F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & f.isin(*words)))
    return F.when(F.size(got) > 0, got)


def xmltable(s: Column, row_path: str, columns: dict[str, tuple[str, str]]) -> Column:
    """Array of structs, one for each element of ``row_path``: name to (type, path), ``@name`` for attributes, ``ordinality`` to count."""

    def f(text: str) -> list[dict]:
        import xml.etree.ElementTree as E

        root = E.fromstring(text)
        path = row_path.strip("/").split("/", 1)
        found = root.findall(path[1]) if len(path) > 1 and path[0] == root.tag else [root] if path == [root.tag] else []
        out = []
        for i, e in enumerate(found):
            row = {}
            for n, (t, p) in columns.items():
                if t == "ordinality":
                    row[n] = str(i + 1)
                elif p.startswith("@"):
                    row[n] = e.get(p[1:])
                elif p == ".":
                    row[n] = "".join(e.itertext())
                else:
                    x = e.find(p)
                    row[n] = None if x is None else "".join(x.itertext())
            out.append(row)
        return out

    rows = rowwise(f, T.ArrayType(T.StructType([T.StructField(n, STRING) for n in columns])))(s)
    return F.transform(rows, lambda r: F.struct(*[r[n].try_cast("long" if t == "ordinality" else t).alias(n) for n, (t, _) in columns.items()]))


def int_array_aggregate(x: Column, *by: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], x.alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def int_array_enum(a: Column) -> Column:
    return F.explode(a)
