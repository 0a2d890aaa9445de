"""Files: CSV and JSON Lines as documents, COPY in its text and csv formats, an allow-list of folders."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotAllowed(PermissionError):
    pass


class AllowList:
    """Folders that may be read. A path is inside if one of them is a whole prefix of it, once dots are resolved;
    patterns are checked by what stands before the first one."""

    def __init__(self, *folders: str) -> None:
        self.folders = [self._plain(f) for f in folders]

    @staticmethod
    def _plain(path: str) -> str:
        m = re.match(r"^(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(.*)$", path, re.S)
        scheme, host, rest = m[1] or "file", m[2] or "", m[3]
        rest = posixpath.normpath("/" + re.split(r"[*?{\[]", rest)[0] if rest.startswith("/") else rest)
        return f"{scheme}://{host}{re.sub('^/+', '/', rest)}"

    def check(self, path: str) -> str:
        if "\x00" in path or ".." in path.split("/"):
            raise NotAllowed(path)
        p = self._plain(path)
        if not any(p == f or p.startswith(f.rstrip("/") + "/") for f in self.folders):
            raise NotAllowed(f"{path} is in none of the allowed folders")
        return path


def read_csv(spark: SparkSession, path: str, allowed: AllowList, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """One column ``row``: an object of texts for each line, by header or column1, column2 ..."""
    df = spark.read.csv(allowed.check(path), sep=delimiter, header=has_header, quote='"', escape='"', multiLine=True, inferSchema=False, nullValue="\x00none", emptyValue="")
    if not has_header:
        df = df.toDF(*[f"column{i + 1}" for i in range(len(df.columns))])
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))


def read_json(spark: SparkSession, path: str, allowed: AllowList) -> DataFrame:
    """One column ``row``: the document of each line; blank lines are passed by."""
    lines = spark.read.text(allowed.check(path)).filter(F.trim("value") != "")
    return lines.select(F.col("value").alias("row"))


def read_parquet(spark: SparkSession, path: str, allowed: AllowList) -> DataFrame:
    return spark.read.parquet(allowed.check(path))


# -- COPY ---------------------------------------------------------------------------------------

_OUT = (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"))


class CopyFormat:
    """A format: how columns become a line, and a line an array of fields."""

    def line(self, fields: list[Column]) -> Column:
        raise NotImplementedError

    def fields(self, line: Column) -> Column:
        raise NotImplementedError


class TextFormat(CopyFormat):
    r"""Fields parted by tabs, \N for null, backslashes before what has a meaning."""

    def __init__(self, delimiter: str = "\t", null: str = "\\N") -> None:
        self.delimiter, self.null = delimiter, null

    def line(self, fields: list[Column]) -> Column:
        def show(c: Column) -> Column:
            s = c.cast("string")
            for a, b in _OUT:
                s = F.replace(s, F.lit(a), F.lit(b))
            if self.delimiter != "\t":
                s = F.replace(s, F.lit(self.delimiter), F.lit("\\" + self.delimiter))
            return F.coalesce(s, F.lit(self.null))

        return F.concat_ws(self.delimiter, *[show(c) for c in fields])

    def fields(self, line: Column) -> Column:
        d = re.escape(self.delimiter)
        parts = F.regexp_extract_all(F.concat(line, F.lit(self.delimiter)), F.lit(rf"(?s)((?:[^\\{d}]++|\\.)*+){d}"), F.lit(1))
        marks = {b: a for a, b in _OUT}

        def plain(s: Column) -> Column:
            hold = "\x00"
            out = F.replace(s, F.lit("\\\\"), F.lit(hold))
            for b, a in marks.items():
                if b != "\\\\":
                    out = F.replace(out, F.lit(b), F.lit(a))
            out = F.regexp_replace(out, r"\\(.)", "$1")
            return F.when(s == self.null, F.lit(None)).otherwise(F.replace(out, F.lit(hold), F.lit("\\")))

        return F.transform(parts, plain)


class CsvFormat(CopyFormat):
    """Quotes where a field needs them; an empty field without quotes is null."""

    def __init__(self, delimiter: str = ",", null: str = "", quote: str = '"', force_quote: tuple[int, ...] = ()) -> None:
        self.delimiter, self.null, self.quote, self.force_quote = delimiter, null, quote, force_quote

    def line(self, fields: list[Column]) -> Column:
        def show(i: int, c: Column) -> Column:
            s = c.cast("string")
            q = F.concat(F.lit(self.quote), F.replace(s, F.lit(self.quote), F.lit(self.quote * 2)), F.lit(self.quote))
            need = s.contains(self.delimiter) | s.contains(self.quote) | s.contains("\n") | s.contains("\r") | (s == self.null) | (s == "\\.") | F.lit(i in self.force_quote)
            return F.coalesce(F.when(need, q).otherwise(s), F.lit(self.null))

        return F.concat_ws(self.delimiter, *[show(i, c) for i, c in enumerate(fields)])

    def fields(self, line: Column) -> Column:
        d, q = re.escape(self.delimiter), re.escape(self.quote)
        raw = F.regexp_extract_all(F.concat(line, F.lit(self.delimiter)), F.lit(rf"(?s)((?:{q}(?:[^{q}]++|{q}{q})*+{q}|[^{d}{q}]++)*+){d}"), F.lit(1))
        plain = lambda s: F.replace(F.regexp_replace(s, rf"^{q}((?s:.*)){q}$", "$1"), F.lit(self.quote * 2), F.lit(self.quote))
        return F.transform(raw, lambda s: F.when(s == self.null, F.lit(None)).when(s.startswith(self.quote), plain(s)).otherwise(s))


FORMATS: dict[str, type[CopyFormat]] = {"text": TextFormat, "csv": CsvFormat}


def register_format(name: str, cls: type[CopyFormat]) -> None:
    """A format of one's own, by name."""
    FORMATS[name] = cls


def copy_to(df: DataFrame, path: str, format: str = "text", header: bool = False, **options) -> None:
    """COPY TO: one line a row; of a query or of what a change of rows returned just as well."""
    f = FORMATS[format](**options)
    lines = df.select(f.line([F.col(f"`{c}`") for c in df.columns]).alias("value"))
    if header:
        spark = df.sparkSession
        head = spark.range(1).select(f.line([F.lit(c) for c in df.columns]).alias("value"))
        head.write.mode("append").text(f"{path}/head")
        lines.write.mode("append").text(f"{path}/rows")
    else:
        lines.write.text(path)


def copy_from(spark: SparkSession, path: str, schema: str, allowed: AllowList, format: str = "text", header: bool = False, on_error: str = "stop", reject_limit: int | None = None, default: str | None = None, defaults: dict[str, Column] | None = None, **options) -> DataFrame:
    """COPY FROM. on_error ``stop`` raises an error at the first line that doesn't fit; ``ignore`` passes such lines by, and raises one if
    they are more than ``reject_limit``. A field that equals ``default`` takes the column's default. Lines end rows, so quoted fields
    hold no line ends."""
    f = FORMATS[format](**options)
    fields = T._parse_datatype_string(schema).fields
    lines = spark.read.text(allowed.check(f"{path}/rows" if header else path))
    parts = F.col("f")
    got = lines.select(f.fields(F.col("value")).alias("f"))
    values, ok = [], F.size(parts) == len(fields)
    for i, field in enumerate(fields):
        raw = F.get(parts, F.lit(i))
        v = raw.try_cast(field.dataType)
        good = raw.isNull() | v.isNotNull()
        if default is not None:
            other = (defaults or {}).get(field.name, F.lit(None))
            v, good = F.when(raw == default, other.cast(field.dataType)).otherwise(v), good | (raw == default)
        values.append(v.alias(field.name))
        ok = ok & F.coalesce(good, F.lit(False))
    if on_error == "ignore":
        if reject_limit is not None and got.filter(~ok).limit(reject_limit + 1).count() > reject_limit:
            raise ValueError(f"more than {reject_limit} lines don't fit")
        return got.filter(ok).select(*values)
    bad = F.raise_error(F.concat(F.lit("a line doesn't fit the columns: "), F.array_join(parts, "|")))
    return got.select(F.when(~ok, bad.cast("boolean")).alias("__bad"), *values).filter("__bad is null").drop("__bad")
