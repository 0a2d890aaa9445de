"""Strings and bytes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import BOOL, STRING, STRINGS, col, rowwise, strict

# -- slices -------------------------------------------------------------------------------------


def left(s: Column, n) -> Column:
    """The first n characters; all but the last -n where n is negative."""
    n = col(n)
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s: Column, n) -> Column:
    """The last n characters; all but the first -n where n is negative."""
    n, size = col(n), F.length(s)
    keep = F.when(n >= 0, F.least(n, size)).otherwise(F.greatest(size + n, F.lit(0)))
    return F.substring(s, size - keep + 1, keep)


def substr(s: Column, start, count=None) -> Column:
    """From a position that may lie before the text, where the count begins all the same."""
    start = col(start)
    first = F.greatest(start, F.lit(1))
    size = F.lit(1 << 30) if count is None else F.greatest(start + col(count) - first, F.lit(0))
    return F.substring(s, first.cast("int"), size.cast("int"))


substring = substr


def overlay(s: Column, new, start, count=None) -> Column:
    start = col(start)
    size = F.length(col(new)) if count is None else col(count)
    return F.concat(substr(s, 1, start - 1), col(new), substr(s, start + size))


def concat(*cols) -> Column:
    """Of what isn't null; never null."""
    return F.concat_ws("", *[col(c).cast("string") for c in cols])


def strpos(s: Column, part) -> Column:
    return F.locate(part, s) if isinstance(part, str) else F.call_function("position", part, s)


def initcap(s: Column) -> Column:
    """A word is a run of letters and digits."""
    parts = F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


casefold = rowwise(str.casefold, STRING)


def split_part(s: Column, delimiter, n) -> Column:
    return F.split_part(s, col(delimiter), col(n))


def trim(s: Column, chars=" ", side: str = "both") -> Column:
    """Characters of a set off the start (``leading``), the end (``trailing``) or both."""
    f = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side]
    return f(s, col(chars))


def chr_(n) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n)), 8, "0")), "UTF-32")


def ascii_(s: Column) -> Column:
    """The code point of the first character, 0 of nothing."""
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.conv(F.hex(F.encode(F.substring(s, 1, 1), "UTF-32")), 16, 10).cast("int"))


def to_base(n: Column, base: int, bits: int = 64) -> Column:
    """Digits of the two's complement of a number of ``bits`` bits."""
    n = n.cast("long") if bits == 64 else n.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    if base == 16:
        return F.lower(F.hex(n))
    text = F.bin(n)
    if base == 2:
        return text
    wide = F.lpad(text, 66, "0")
    digits = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.conv(F.substring(wide, i * 3 + 1, F.lit(3)), 2, 8))
    return F.regexp_replace(F.array_join(digits, ""), "^0+(?=.)", "")


def to_hex(n: Column, bits: int = 64) -> Column:
    return to_base(n, 16, bits)


# -- bytes --------------------------------------------------------------------------------------


def encode(b: Column, form: str) -> Column:
    """Bytes as text: hex, base64 (lines of 76) or escape."""
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        return F.regexp_replace(F.regexp_replace(F.base64(b), "\\s", ""), "(.{76})(?=.)", "$1\n")
    codes = F.transform(F.split(F.decode(b, "ISO-8859-1"), ""), lambda c: F.when(c == "\\", F.lit("\\\\")).when((F.ascii(c) >= 128) | (c == "\x00"), F.concat(F.lit("\\"), F.lpad(F.conv(F.hex(F.encode(c, "ISO-8859-1")), 16, 8), 3, "0"))).otherwise(c))
    return F.when(F.length(b) == 0, F.lit("")).otherwise(F.array_join(codes, ""))


def _unescape(s: str) -> bytes:
    return re.sub(rb"\\(\\|[0-3][0-7]{2})", lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8)]), s.encode())


def decode(s: Column, form: str) -> Column:
    from pyspark.sql.types import BinaryType

    if form == "hex":
        return F.unhex(F.regexp_replace(s, r"\s", ""))
    if form == "base64":
        return F.unbase64(F.regexp_replace(s, r"\s", ""))
    return rowwise(_unescape, BinaryType())(s)


def convert_to(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


def convert_from(b: Column, charset: str = "UTF-8") -> Column:
    return F.decode(b, charset)


def sha(b: Column, bits: int) -> Column:
    """sha224, sha256, sha384, sha512 in hexadecimal."""
    return F.sha2(b, bits)


def get_byte(b: Column, i) -> Column:
    return F.conv(F.hex(F.substring(b, col(i) + 1, F.lit(1))), 16, 10).cast("int")


def set_byte(b: Column, i, value) -> Column:
    i = col(i)
    return F.concat(F.substring(b, F.lit(1), i), F.unhex(F.lpad(F.hex(col(value).bitwiseAND(255)), 2, "0")), F.substring(b, i + 2, F.length(b)))


def get_bit(b: Column, n) -> Column:
    """Bits count from the least of the first byte."""
    n = col(n)
    return F.getbit(get_byte(b, F.floor(n / 8).cast("int")), (n % 8).cast("int")).cast("int")


def set_bit(b: Column, n, value) -> Column:
    n = col(n)
    at, one = F.floor(n / 8).cast("int"), F.call_function("shiftleft", F.lit(1), (n % 8).cast("int"))
    old = get_byte(b, at)
    return set_byte(b, at, F.when(col(value) == 1, old.bitwiseOR(one)).otherwise(old.bitwiseAND(F.bitwise_not(one))))


def bit_count(b: Column) -> Column:
    """Bits set in a string of bytes."""
    return F.length(F.replace(F.array_join(F.transform(F.regexp_extract_all(F.hex(b), F.lit("."), F.lit(0)), lambda d: F.conv(d, 16, 2)), ""), F.lit("0"), F.lit(""))).cast("long")


# -- unicode ------------------------------------------------------------------------------------

normalize = rowwise(lambda s, form: unicodedata.normalize(form, s), STRING)
is_normalized = rowwise(lambda s, form: unicodedata.is_normalized(form, s), BOOL)
unicode_assigned = rowwise(lambda s: all(unicodedata.category(c) != "Cn" for c in s), BOOL)
to_ascii = rowwise(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if ord(c) < 128), STRING)


def unaccent(s: Column) -> Column:
    """Without marks; what has no plain form stays."""
    return rowwise(lambda s: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))), STRING)(s)


def _unistr(s: str) -> str:
    def one(m: re.Match) -> str:
        return "\\" if m[0] == "\\\\" else chr(int(next(g for g in m.groups() if g), 16))

    out = re.sub(r"\\\\|\\\+([0-9A-Fa-f]{6})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\([0-9A-Fa-f]{4})", one, s)
    return out.encode("utf-16", "surrogatepass").decode("utf-16")


unistr = rowwise(_unistr, STRING)

# -- quoting ------------------------------------------------------------------------------------

#: Words that an identifier can't be without quotes.
RESERVED = tuple(
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit boolean both case cast char character check coalesce collate collation column concurrently constraint create cross current_catalog current_date current_role current_schema current_time current_timestamp current_user dec decimal default deferrable desc distinct do else end except exists extract false fetch float for foreign freeze from full grant greatest group grouping having ilike in initially inner inout int integer intersect interval into is isnull join lateral leading least left like limit localtime localtimestamp natural national nchar none normalize not notnull null nullif numeric offset on only or order out outer overlaps overlay placing position precision primary real references returning right row select session_user setof similar smallint some substring symmetric system_user table tablesample then time timestamp to trailing treat trim true union unique user using values varchar variadic verbose when where window with xmlattributes xmlconcat xmlelement xmlexists xmlforest xmlnamespaces xmlparse xmlpi xmlroot xmlserialize xmltable".split()
)


def _quote_ident(s: str) -> str:
    return s if re.fullmatch("[a-z_][a-z0-9_]*", s) and s not in RESERVED else '"' + s.replace('"', '""') + '"'


def _quote_literal(s: str) -> str:
    q = "'" + s.replace("'", "''").replace("\\", "\\\\") + "'"
    return ("E" if "\\" in s else "") + q


def quote_ident(s: Column) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_]*$") & ~s.isin(*RESERVED)
    return F.when(plain, s).when(s.isNotNull(), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s: Column) -> Column:
    q = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit("E"), q)).otherwise(q)


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def _format(form: str, args: list) -> str:
    out, at, nth = [], 0, 0
    for m in re.finditer(r"%(?:%|(?:(\d+)\$)?(-)?(?:(\d+)|\*(?:(\d+)\$)?)?([sIL]))", form):
        out.append(form[at : m.start()])
        at = m.end()
        if m[0] == "%%":
            out.append("%")
            continue
        width, flush = int(m[3] or 0), bool(m[2])
        if "*" in m[0]:
            nth = int(m[4]) if m[4] else nth + 1
            width = int(args[nth - 1] or 0)
            flush, width = flush or width < 0, abs(width)
        nth = int(m[1]) if m[1] else nth + 1
        v = args[nth - 1]
        if m[5] == "s":
            v = "" if v is None else v
        elif m[5] == "I":
            v = _quote_ident(v)
        else:
            v = "NULL" if v is None else _quote_literal(v)
        out.append(v.ljust(width) if flush else v.rjust(width))
    return "".join(out) + form[at:]


def format_(form, *args) -> Column:
    """%s, %I and %L with positions and widths."""
    return rowwise(_format, STRING)(form, F.array(*[col(a).cast("string") for a in args]) if args else F.array().cast("array<string>"))


def _parse_ident(s: str) -> list[str]:
    out, at = [], 0
    token = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_\x80-￿][\w$]*))\s*(\.|$)')
    while True:
        m = token.match(s, at)
        if not m:
            raise ValueError(f"string is not a valid identifier: {s!r}")
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2].lower())
        at = m.end()
        if m[3] != ".":
            return out


parse_ident = rowwise(_parse_ident, STRINGS)

# -- arrays of text -----------------------------------------------------------------------------


def string_to_array(s: Column, delimiter, null_string: str | None = None) -> Column:
    """A null delimiter parts all characters, an empty one none; an empty text has no parts."""
    if delimiter is None:
        out = F.filter(F.split(s, ""), lambda x: x != "")
    elif delimiter == "":
        out = F.array(s)
    else:
        out = F.split(s, re_literal(delimiter), -1)
    out = F.when(F.length(s) == 0, F.array().cast("array<string>")).when(s.isNotNull(), out)
    return out if null_string is None else F.transform(out, lambda x: F.nullif(x, F.lit(null_string)))


def string_to_table(s: Column, delimiter, null_string: str | None = None) -> Column:
    """A row for each part."""
    return F.explode(string_to_array(s, delimiter, null_string))


def array_to_string(a: Column, delimiter: str, null_string: str | None = None) -> Column:
    a = F.transform(a, lambda x: x.cast("string"))
    return F.array_join(a, delimiter) if null_string is None else F.array_join(a, delimiter, null_string)


def re_literal(s: str) -> str:
    """A pattern that matches just this text."""
    return re.sub(r"([^\w\s])", r"\\\1", s)


def nulls(*cols) -> tuple[Column, Column]:
    """(num_nulls, num_nonnulls)."""
    n = F.lit(0)
    for c in cols:
        n = n + F.when(col(c).isNull(), 1).otherwise(0)
    return n, F.lit(len(cols)) - n


def lpad(s: Column, n, fill=" ") -> Column:
    return strict(F.lpad(s, col(n), col(fill)), s)
