"""Dates, times, intervals and templates, on inputs where the dialect and Spark differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import dates as D
from tessella.plans.registry import cases, expect

O = "SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS timestamp_ntz) + make_dt_interval(0, o_orderkey % 24, o_orderkey % 60, o_orderkey % 59) AS ts FROM orders"
SQL_O = "(SELECT o_orderkey, o_orderdate, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) + to_seconds((o_orderkey % 59)::DOUBLE) AS ts FROM orders)"
c = F.col
PARTS = ("year", "month", "day", "quarter", "doy", "dow", "isodow", "week", "isoyear", "decade", "century", "millennium", "hour", "minute", "second", "epoch", "julian")


@cases("fn_date_parts", O, f"SELECT o_orderkey, {', '.join(f'round(date_part({chr(39)}{p}{chr(39)}, ts)::DOUBLE, 6) AS {p}' for p in PARTS)} FROM {SQL_O}")
def _():
    return {"o_orderkey": c("o_orderkey"), **{p: F.round(D.extract(p, c("ts")), 6) for p in PARTS}}


TRUNC = ("decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second")


@cases("fn_date_trunc", O, f"SELECT o_orderkey, {', '.join(f'strftime(date_trunc({chr(39)}{p}{chr(39)}, ts)::TIMESTAMP, {chr(39)}%Y-%m-%d %H:%M:%S{chr(39)}) AS {p}' for p in TRUNC)} FROM {SQL_O}")
def _():
    return {"o_orderkey": c("o_orderkey"), **{p: F.date_format(D.date_trunc(p, c("ts")), "yyyy-MM-dd HH:mm:ss") for p in TRUNC}}


@cases("fn_date_trunc_long", "SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2001-02-16 20:38:40'), (2, TIMESTAMP_NTZ '2000-12-31 00:00:00') AS t(k, ts)", expect("k, m, c", (1, "2001-01-01", "2001-01-01"), (2, "1001-01-01", "1901-01-01")))
def _():
    f = lambda x: F.date_format(x, "yyyy-MM-dd")
    return {"k": c("k"), "m": f(D.date_trunc("millennium", c("ts"))), "c": f(D.date_trunc("century", c("ts")))}


@cases("fn_date_bin", O, f"SELECT o_orderkey, strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2001-01-01 00:05:00'), '%Y-%m-%d %H:%M:%S') AS b FROM {SQL_O}")
def _():
    return {"o_orderkey": c("o_orderkey"), "b": F.date_format(D.date_bin(15 * D.MINUTE, c("ts"), F.lit("2001-01-01 00:05:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")}


@cases(
    "fn_date_age",
    "SELECT k, CAST(a AS timestamp_ntz) AS a, CAST(b AS timestamp_ntz) AS b FROM VALUES (1, '2001-04-10', '1957-06-13'), (2, '2004-03-01', '2004-01-31'), (3, '2004-01-31', '2004-03-01'), (4, '2020-01-01 10:00:00', '2020-01-01 09:30:15'), (5, NULL, '2020-01-01') AS t(k, a, b)",
    expect("k, age, diff", (1, "43 years 9 mons 27 days", "16007 days"), (2, "1 mon 1 day", "30 days"), (3, "-1 mons -1 days", "-30 days"), (4, "00:29:45", "00:29:45"), (5, None, None)),
)
def _():
    return {"k": c("k"), "age": D.interval_text(D.age(c("a"), c("b"))), "diff": D.interval_text(D.difference(c("a"), c("b")))}


@cases(
    "fn_interval_justify",
    "SELECT 1",
    expect("h, d, i, neg, made, epoch, hour", ("3 days 03:00:00", "1 mon 5 days", "29 days 23:00:00", "-2 days -02:00:00", "1 year 2 mons 10 days 10:00:01.5", 5184000.0, 27.0)),
)
def _():
    I = D.interval
    return {
        "h": D.interval_text(D.justify_hours(I(days=2, hours=27))), "d": D.interval_text(D.justify_days(I(days=35))), "i": D.interval_text(D.justify_interval(I(months=1, hours=-1))),
        "neg": D.interval_text(D.justify_hours(I(hours=-50))), "made": D.interval_text(I(years=1, months=2, weeks=1, days=3, hours=10, secs=1.5)), "epoch": D.extract_interval("epoch", I(months=2)), "hour": D.extract_interval("hour", I(hours=27, mins=5)),
    }


@cases("fn_date_add_interval", O, f"SELECT o_orderkey, strftime(ts + INTERVAL 1 MONTH + INTERVAL 3 DAYS + INTERVAL 90 MINUTES, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts - INTERVAL 13 MONTHS, '%Y-%m-%d %H:%M:%S') AS b FROM {SQL_O}")
def _():
    f = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return {"o_orderkey": c("o_orderkey"), "a": f(D.add(c("ts"), D.interval(months=1, days=3, mins=90))), "b": f(D.add(c("ts"), D.interval(months=-13)))}


@cases(
    "fn_date_overlaps",
    "SELECT k, CAST(a AS date) AS a, CAST(b AS date) AS b, CAST(c AS date) AS c, CAST(d AS date) AS d FROM VALUES (1, '2001-02-16', '2001-12-21', '2001-10-30', '2002-10-30'), (2, '2001-02-16', '2001-05-27', '2001-10-30', '2002-10-30'), (3, '2001-10-29', '2001-10-30', '2001-10-30', '2001-10-31'), (4, '2001-10-30', '2001-10-30', '2001-10-30', '2001-10-31'), (5, '2001-12-21', '2001-02-16', '2001-03-01', '2001-02-20') AS t(k, a, b, c, d)",
    expect("k, o", (1, True), (2, False), (3, False), (4, True), (5, True)),
)
def _():
    return {"k": c("k"), "o": D.overlaps(c("a"), c("b"), c("c"), c("d"))}


@cases("fn_date_to_char", O, f"""SELECT o_orderkey, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%d') || ' ' || rpad(monthname(ts), 9, ' ') || '|' || upper(strftime(ts, '%b')) || '|' || lower(strftime(ts, '%a')) AS names,
    (date_part('day', ts)::INT)::VARCHAR || '/' || (date_part('month', ts)::INT)::VARCHAR || ' Q' || quarter(ts)::VARCHAR || ' ' || strftime(ts, '%I') || strftime(ts, '%p') || ' wk' || strftime(ts, '%V') || ' of ' || date_part('isoyear', ts)::VARCHAR || ' d' || (dayofyear(ts))::VARCHAR AS mixed FROM {SQL_O}""")
def _():
    t = c("ts")
    return {"o_orderkey": c("o_orderkey"), "iso": D.to_char(t, "YYYY-MM-DD HH24:MI:SS"), "names": D.to_char(t, "DD Month|MON|dy"), "mixed": D.to_char(t, 'FMDD/FMMM "Q"Q HH12AM "wk"IW "of" IYYY "d"FMDDD')}


@cases("fn_date_parse", "SELECT '05 Dec 2000' AS a, '2000-12-05 14:30:09' AS b", expect("d, t, mk, tz, z, tm", ("2000-12-05", "2000-12-05 14:30:09", "2013-07-15 08:15:23", "2013-07-15 06:15:23", "2001-02-16 19:38:40", "08:15:23")))
def _():
    f = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return {
        "d": D.to_date(c("a"), "DD Mon YYYY").cast("string"), "t": f(D.to_timestamp(c("b"), "YYYY-MM-DD HH24:MI:SS")), "mk": f(D.make_timestamp(2013, 7, 15, 8, 15, 23)),
        "tz": f(D.make_timestamptz(2013, 7, 15, 8, 15, 23, "Europe/Berlin")), "z": f(D.timezone("America/Denver", F.lit("2001-02-17 02:38:40").cast("timestamp"), True)), "tm": D.time_text(D.make_time(8, 15, 23)),
    }


@cases("fn_date_zone", O, f"SELECT o_orderkey, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver', '%Y-%m-%d %H:%M:%S') AS z FROM {SQL_O}")
def _():
    return {"o_orderkey": c("o_orderkey"), "z": F.date_format(D.timezone("America/Denver", c("ts").cast("timestamp"), True), "yyyy-MM-dd HH:mm:ss")}


@cases("fn_date_now", "SELECT 1", expect("same, day, local, fin", (True, True, True, True)))
def _():
    now, clock = F.now(), F.current_timestamp()
    return {"same": now == clock, "day": F.to_date(now) == F.current_date(), "local": F.localtimestamp() == now.cast("timestamp_ntz"), "fin": D.isfinite(F.current_date())}


@cases(
    "fn_number_to_char",
    "SELECT * FROM VALUES (1, 485D), (2, -485D), (3, 1485D), (4, 0.1D), (5, 148.5D), (6, 12D) AS t(k, x)",
    expect(
        "k, plain, grouped, zero, pr, mi, fm, frac, over",
        (1, "  485", "   485.00", " 0485", "  485 ", "485 ", "485.0", " 485.00", " 485"),
        (2, " -485", "  -485.00", "-0485", " <485>", "485-", "-485.0", "-485.00", "-485"),
        (3, " 1485", " 1,485.00", " 1485", " 1485 ", " ###", "1485.0", " ###.##", " ###"),
        (4, "    0", "      .10", " 0000", "    0 ", "  0 ", ".1", "    .10", "   0"),
        (5, "  149", "   148.50", " 0149", "  149 ", "149 ", "148.5", " 148.50", " 149"),
        (6, "   12", "    12.00", " 0012", "   12 ", " 12 ", "12.0", "  12.00", "  12"),
    ),
)
def _():
    x = c("x")
    return {"k": c("k"), "plain": D.to_char_number(x, "9999"), "grouped": D.to_char_number(x, "9,999.99"), "zero": D.to_char_number(x, "0999"), "pr": D.to_char_number(x, "9999PR"), "mi": D.to_char_number(x, "999MI"), "fm": D.to_char_number(x, "FM9999.09"), "frac": D.to_char_number(x, "999.99"), "over": D.to_char_number(x, "999")}


@cases("fn_to_number", "SELECT * FROM VALUES ('12,454.8-', '99G999D9S'), ('-34,338.49', '99,999.99'), ('<564646.65>', '999999.99PR') AS t(s, f)", expect("s, n", ("12,454.8-", -12454.8), ("-34,338.49", -34338.49), ("<564646.65>", -564646.65)))
def _():
    return {"s": c("s"), "n": D.to_number(c("s"), "")}
