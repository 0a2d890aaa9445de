"""Dates, times and intervals. A full interval is a struct of months, days and micros, as these don't convert
into each other; times of day are microseconds since midnight."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import col, let

DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000


def interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0) -> Column:
    """make_interval."""
    c = lambda x: col(x).cast("long") if isinstance(x, int) else col(x)
    micros = (c(hours) * HOUR + c(mins) * MINUTE).cast("long") + F.round(c(secs) * SECOND).cast("long")
    return F.struct((c(years) * 12 + c(months)).cast("long").alias("months"), (c(weeks) * 7 + c(days)).cast("long").alias("days"), micros.alias("micros"))


def _toward_zero(x: Column, n: int) -> Column:
    return F.when(x >= 0, F.floor(x / n)).otherwise(F.ceil(x / n)).cast("long")


def _iv(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), micros.cast("long").alias("micros"))


def _carry(high: Column, low: Column, size: int) -> Column:
    """(high, low) with whole ``size``s of low moved to high and one sign for both."""

    def signed(h: Column, r: Column) -> Column:
        up, down = (h > 0) & (r < 0), (h < 0) & (r > 0)
        return F.struct(F.when(up, h - 1).when(down, h + 1).otherwise(h).alias("high"), F.when(up, r + size).when(down, r - size).otherwise(r).alias("low"))

    return let(lambda h, r: signed(h, r), high + _toward_zero(low, size), low - _toward_zero(low, size) * size)


def justify_hours(i: Column) -> Column:
    """24 hours become a day; both parts get one sign."""
    return let(lambda i: let(lambda c: _iv(i["months"], c["high"], c["low"]), _carry(i["days"], i["micros"], DAY)), i)


def justify_days(i: Column) -> Column:
    """30 days become a month."""
    return let(lambda i: let(lambda c: _iv(c["high"], c["low"], i["micros"]), _carry(i["months"], i["days"], 30)), i)


def justify_interval(i: Column) -> Column:
    """Both, and one sign for all parts."""

    def months(j: Column) -> Column:
        m, d, t = j["months"], j["days"], j["micros"]
        up = (m > 0) & ((d < 0) | ((d == 0) & (t < 0)))
        down = (m < 0) & ((d > 0) | ((d == 0) & (t > 0)))
        return _iv(F.when(up, m - 1).when(down, m + 1).otherwise(m), F.when(up, d + 30).when(down, d - 30).otherwise(d), t)

    def days(j: Column) -> Column:
        d, t = j["days"], j["micros"]
        up, down = (d > 0) & (t < 0), (d < 0) & (t > 0)
        return _iv(j["months"], F.when(up, d - 1).when(down, d + 1).otherwise(d), F.when(up, t + DAY).when(down, t - DAY).otherwise(t))

    return let(lambda j: let(days, months(j)), justify_days(justify_hours(i)))


def interval_text(i: Column) -> Column:
    """Like ``1 year 2 mons -3 days 04:05:06.7``."""
    return let(_interval_text, i)


def _interval_text(i: Column) -> Column:
    y, m = _toward_zero(i["months"], 12), i["months"] - _toward_zero(i["months"], 12) * 12
    t = F.abs(i["micros"])
    named = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    hours = F.floor(t / HOUR)
    part = F.regexp_replace(F.lpad((t % SECOND).cast("string"), 6, "0"), "0+$", "")
    clock = F.concat(F.when(i["micros"] < 0, F.lit("-")).otherwise(F.lit("")), F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(t / MINUTE) % 60), F.lit(":"), two(F.floor(t / SECOND) % 60), F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
    text = F.concat_ws(" ", named(y, "year", "years"), named(m, "mon", "mons"), named(i["days"], "day", "days"), F.when(i["micros"] != 0, clock))
    return F.when(i["months"].isNotNull(), F.when(text == "", F.lit("00:00:00")).otherwise(text))


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age(later: Column, earlier: Column) -> Column:
    """Years and months, days and time between two moments, by the calendar: borrowed days are those of the
    earlier moment's month."""

    def forward(a: Column, b: Column) -> tuple[Column, Column, Column]:  # a >= b
        t = (micros_of(a) % DAY) - (micros_of(b) % DAY)
        d = F.dayofmonth(a) - F.dayofmonth(b)
        m = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
        d, t = F.when(t < 0, d - 1).otherwise(d), F.when(t < 0, t + DAY).otherwise(t)
        return F.when(d < 0, m - 1).otherwise(m), F.when(d < 0, d + F.dayofmonth(F.last_day(b))).otherwise(d), t

    def back(a: Column, b: Column) -> tuple[Column, Column, Column]:  # a < b: the same, negated, with a's month
        m, d, t = forward(b, a)
        return -m, -d, -t

    p, n = forward(later, earlier), back(later, earlier)
    return F.when(later >= earlier, _iv(*p)).when(later < earlier, _iv(*n))


def add(ts: Column, i: Column) -> Column:
    """Months first, then days, then time; a day beyond the month's end is its last."""

    def moved(ts: Column, i: Column) -> Column:
        day = F.add_months(ts, i["months"].cast("int"))
        return F.timestamp_micros(F.unix_date(day).cast("long") * DAY + F.pmod(micros_of(ts), F.lit(DAY)) + i["days"] * DAY + i["micros"]).cast("timestamp_ntz")

    return let(moved, ts, i)


def difference(a: Column, b: Column) -> Column:
    """An interval of days and time."""
    d = micros_of(a) - micros_of(b)
    days = _toward_zero(d, DAY)
    return F.when(d.isNotNull(), _iv(F.lit(0), days, d - days * DAY))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open periods, in either order of their ends; one of no length is a moment."""
    a, b = F.least(s1, e1), F.greatest(s1, e1)
    c, d = F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, F.lit(True)).when(a > c, a < d).otherwise(c < b)


def extract(field: str, ts: Column) -> Column:
    """date_part."""
    y, t = F.year(ts), F.pmod(micros_of(ts), F.lit(DAY))
    fields = {
        "year": y, "month": F.month(ts), "day": F.dayofmonth(ts), "quarter": F.quarter(ts), "doy": F.dayofyear(ts),
        "dow": F.dayofweek(ts) - 1, "isodow": F.weekday(ts) + 1, "week": F.weekofyear(ts), "isoyear": F.year(F.date_add(ts, 3 - F.weekday(ts))),
        "decade": F.floor(y / 10), "century": F.ceil(y / 100), "millennium": F.ceil(y / 1000),
        "hour": F.floor(t / HOUR), "minute": F.floor(t / MINUTE) % 60, "second": (t % MINUTE) / 1e6, "milliseconds": (t % MINUTE) / 1e3, "microseconds": t % MINUTE,
        "epoch": micros_of(ts) / 1e6, "julian": F.datediff(ts, F.lit("2000-01-01")) + 2451545 + t / DAY,
    }
    return fields[field.lower()].cast("double")


def extract_interval(field: str, i: Column) -> Column:
    return let(lambda i: _part(field, i), i)


def _part(field: str, i: Column) -> Column:
    y = _toward_zero(i["months"], 12)
    fields = {
        "year": y, "month": i["months"] - y * 12, "day": i["days"], "hour": _toward_zero(i["micros"], HOUR),
        "minute": _toward_zero(i["micros"] % HOUR, MINUTE), "second": (i["micros"] % MINUTE) / 1e6,
        "epoch": (y * 365.25 + (i["months"] - y * 12) * 30 + i["days"]) * 86400.0 + i["micros"] / 1e6,
    }
    return fields[field.lower()].cast("double")


def date_trunc(field: str, ts: Column) -> Column:
    y = F.year(ts)
    first = lambda year: F.make_timestamp_ntz(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    long = {"decade": F.floor(y / 10) * 10, "century": (F.ceil(y / 100) - 1) * 100 + 1, "millennium": (F.ceil(y / 1000) - 1) * 1000 + 1}
    return first(long[field]) if field in long else F.date_trunc(field, ts).cast("timestamp_ntz")


def date_bin(micros: int, ts: Column, origin: Column) -> Column:
    """The start of the stride that holds ts, counted from origin."""
    d = micros_of(ts) - micros_of(origin)
    return F.timestamp_micros(micros_of(ts) - F.pmod(d, F.lit(micros))).cast("timestamp_ntz")


def make_time(h, m, s) -> Column:
    return col(h).cast("long") * HOUR + col(m).cast("long") * MINUTE + F.round(col(s) * SECOND).cast("long")


def time_text(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(t), "HH:mm:ss")


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(*[col(x) for x in (y, mo, d, h, mi)], col(s).cast("decimal(16,6)"))


def make_timestamptz(y, mo, d, h, mi, s, zone: str) -> Column:
    return F.make_timestamp_ltz(*[col(x) for x in (y, mo, d, h, mi)], col(s).cast("decimal(16,6)"), F.lit(zone))


def timezone(zone: str, ts: Column, aware: bool) -> Column:
    """AT TIME ZONE: of a moment, the clock there; of a clock time, the moment (as UTC clock time)."""
    return (F.from_utc_timestamp(ts, zone) if aware else F.to_utc_timestamp(ts, zone)).cast("timestamp_ntz")


def isfinite(x: Column) -> Column:
    """Spark's dates and times have no infinities."""
    return F.when(x.isNotNull(), F.lit(True))


#: Template words and the JVM's letters for them, longest first where one begins another.
_WORDS = (
    ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("am", "\x01a"), ("pm", "\x01a"),
    ("YYYY", "yyyy"), ("YYY", "\x02y"), ("YY", "yy"), ("MONTH", "\x03MMMM"), ("Month", "\x05MMMM"), ("month", "\x04MMMM"), ("MON", "\x03MMM"), ("Mon", "MMM"), ("mon", "\x04MMM"), ("MM", "MM"),
    ("DAY", "\x03EEEE"), ("Day", "\x05EEEE"), ("day", "\x04EEEE"), ("DY", "\x03EEE"), ("Dy", "EEE"), ("dy", "\x04EEE"), ("DDD", "DDD"), ("DD", "dd"), ("Q", "q"), ("TZ", "z"),
)


def _pieces(template: str) -> list[tuple[bool, str, str]]:
    """(fill mode, letters, literal) of a template."""
    out, i = [], 0
    while i < len(template):
        fm = template.startswith("FM", i)
        j = i + 2 if fm else i
        if template[i] == '"':
            end = template.index('"', i + 1)
            out.append((False, "", template[i + 1 : end]))
            i = end + 1
            continue
        for word, letters in _WORDS:
            if template.startswith(word, j):
                out.append((fm, letters, ""))
                i = j + len(word)
                break
        else:
            special = re.match("IYYY|IW|ID|WW|W|J|CC|D", template[j:])
            if special:
                out.append((fm, "=" + special[0], ""))
                i = j + len(special[0])
            else:
                out.append((False, "", template[i]))
                i += 1
    return out


def to_char(ts: Column, template: str) -> Column:
    """A moment by a template: names are padded to nine characters unless FM stands before them, FM drops zeros in front."""
    parts = []
    for fm, letters, text in _pieces(template):
        if not letters:
            parts.append(F.lit(text))
            continue
        if letters[0] == "=":
            n = {"IYYY": extract("isoyear", ts), "IW": F.weekofyear(ts), "ID": F.weekday(ts) + 1, "WW": F.floor((F.dayofyear(ts) - 1) / 7) + 1, "W": F.floor((F.dayofmonth(ts) - 1) / 7) + 1, "J": F.floor(extract("julian", ts)), "CC": F.ceil(F.year(ts) / 100), "D": F.dayofweek(ts)}[letters[1:]]
            s = n.cast("long").cast("string")
            parts.append(s if fm or letters[1:] in ("ID", "W", "J", "D") else F.lpad(s, 4 if letters == "=IYYY" else 2, "0"))
            continue
        mode, name = (letters[0], letters[1:]) if letters[0] < " " else ("", letters)
        if mode == "\x02":
            parts.append(F.lpad((F.year(ts) % 1000).cast("string"), 3, "0"))
            continue
        s = F.date_format(ts, name)
        s = F.upper(s) if mode == "\x03" else F.lower(s) if mode in ("\x04", "\x01") else s
        if name in ("MMMM", "EEEE"):
            s = s if fm else F.rpad(s, 9, " ")
        elif fm and name in ("HH", "hh", "mm", "ss", "MM", "dd", "DDD"):
            s = F.regexp_replace(s, "^0+(?=.)", "")
        parts.append(s)
    return F.concat(*parts)


def to_timestamp(s: Column, template: str) -> Column:
    """A text by a template."""
    letters = "".join((x[1] if x[1][0] >= " " else x[1][1:]) if x[1] else ("'" + x[2].replace("'", "''") + "'" if x[2].isalpha() else x[2]) for x in _pieces(template))
    return F.to_timestamp_ntz(s, F.lit(letters))


def to_date(s: Column, template: str) -> Column:
    return to_timestamp(s, template).cast("date")


def to_char_number(x: Column, template: str) -> Column:
    """A number by a template of 9, 0, comma, point, S, MI, PR, L, FM, in the width that the template has."""
    return rowwise_number(x.cast("decimal(38,10)").cast("string"), template)


def rowwise_number(x: Column, template: str) -> Column:
    from tessella.functions.base import STRING, rowwise

    return rowwise(_number_text, STRING)(x, template)


def _number_text(text: str, template: str) -> str:
    from decimal import ROUND_HALF_UP, Decimal

    x = Decimal(text)
    fm = template.startswith("FM")
    t = template[2:] if fm else template
    pr, mi, lead = t.endswith("PR"), t.endswith("MI"), t.startswith("S")
    trail = t.endswith("S") and not lead
    money = "L" in t
    body = re.sub("PR$|MI$|^S|S$|L", "", t)
    whole, _, part = body.replace("D", ".").replace("G", ",").partition(".")
    digits = sum(c in "90" for c in part)
    n = abs(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    a, _, b = f"{n:f}".partition(".")
    room = sum(c in "90" for c in whole)
    fill = a if a != "0" or "0" in whole or not digits else ""
    if len(fill) > room:
        return " " * (not fm) + re.sub("[90]", "#", body)
    first0 = next((i for i, c in enumerate(c for c in whole if c in "90") if c == "0"), room)
    padded = fill.rjust(room)
    padded = "".join("0" if c == " " and i >= first0 else c for i, c in enumerate(padded))
    out, i, seen = [], 0, False
    for c in whole:
        if c in "90":
            seen |= padded[i] != " "
            out.append(padded[i])
            i += 1
        else:
            out.append(c if seen else " ")
    text = "".join(out)
    if part:
        b = b[:digits]
        if fm:
            keep = max((i + 1 for i, c in enumerate(c for c in part if c in "90") if c == "0"), default=0)
            b = b[:keep] + b[keep:].rstrip("0")
        text += "." + b
    neg = x < 0 and n != 0
    lone = text.lstrip()
    pad = text[: len(text) - len(lone)]
    if pr:
        text = pad + (f"<{lone}>" if neg else f" {lone} ")
    elif mi:
        text = text + ("-" if neg else " ")
    elif trail:
        text = text + ("-" if neg else "+")
    elif lead:
        text = pad + ("-" if neg else "+") + lone
    else:
        text = pad + ("-" if neg else " ") + lone
    if money:
        text = "$" + text
    return text.strip() if fm else text


def to_number(s: Column, template: str) -> Column:
    """The number in a text written by a template: digits, sign and point count."""
    plain = F.regexp_replace(s, r"[^0-9.\-]", "")
    neg = s.rlike("-|^<")
    return F.when(neg, -F.replace(plain, F.lit("-"), F.lit("")).cast("double")).otherwise(plain.cast("double"))
