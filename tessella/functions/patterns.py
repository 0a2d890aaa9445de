"""Regular expressions of the dialect, LIKE and SIMILAR TO. Patterns are Python strings; they are rewritten for the
JVM's engine once, when the plan is made. A group that takes no part in a match counts as empty."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F



def java(pattern: str, flags: str = "") -> str:
    """Word boundaries and classes as the JVM writes them; flags i, n, s, x, c, q."""
    if "q" in flags:
        pattern = re.sub(r"([^\w\s])", r"\\\1", pattern)
    else:
        for a, b in ((r"\m", r"\b(?=\w)"), (r"\M", r"\b(?<=\w)"), (r"\y", r"\b"), (r"\Y", r"\B"), (r"\A", "^"), (r"\Z", "$")):
            pattern = re.sub(r"(?<!\\)((?:\\\\)*)" + re.escape(a), lambda m, b=b: m[1] + b, pattern)
        for name, cls in (("alpha", "Alpha"), ("digit", "Digit"), ("alnum", "Alnum"), ("upper", "Upper"), ("lower", "Lower"), ("space", "Space"), ("punct", "Punct"), ("xdigit", "XDigit"), ("cntrl", "Cntrl"), ("blank", "Blank")):
            pattern = pattern.replace(f"[:{name}:]", f"\\p{{{cls}}}")
    on = "".join(c for c in ("i", "x") if c in flags)
    # without n or p a dot takes line ends too, and ^ and $ are the text's ends
    on += "m" if "n" in flags else "s"
    return f"(?{on}){pattern}"


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(java(pattern, flags))


def _groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)", pattern))


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """Array of the first match's groups (of the match, if there are none); null without a match."""
    p, n = java(pattern, flags), _groups(pattern)
    parts = F.array(*[F.regexp_extract(s, p, i) for i in (range(1, n + 1) if n else (0,))])
    return F.when(s.rlike(p), parts)


def regexp_matches(s: Column, pattern: str, flags: str = "") -> Column:
    """Array of arrays of groups: of all matches with g, else of the first. Explode it for the rows."""
    p, n = java(pattern, flags), _groups(pattern)
    if "g" not in flags:
        one = regexp_match(s, pattern, flags)
        return F.when(one.isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(one))
    each = [F.regexp_extract_all(s, F.lit(p), F.lit(i)) for i in (range(1, n + 1) if n else (0,))]
    return F.transform(each[0], lambda _, i: F.array(*[F.get(e, i) for e in each]))


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    r"""The first match, or all with g. In ``new``, \1 to \9 are groups, \& is the match."""
    p = java(pattern, flags)
    shift = 0 if "g" in flags else 2

    def part(m: re.Match) -> str:
        if m[0] == "$":
            return r"\$"
        if m[1] == "&":
            return f"${shift}"
        return f"${int(m[1]) + shift}" if m[1].isdigit() else r"\\"

    to = re.sub(r"\$|\\([0-9&\\])", part, new)
    if "g" in flags:
        return F.regexp_replace(s, p, to)
    return F.regexp_replace(s, f"(?s)\\A(.*?)({p})", "$1" + to)


def regexp_split_to_array(s: Column, pattern: str, flags: str = "") -> Column:
    return F.split(s, java(pattern, flags), -1)


def regexp_split_to_table(s: Column, pattern: str, flags: str = "") -> Column:
    return F.explode(regexp_split_to_array(s, pattern, flags))


def _from(s: Column, start: int) -> Column:
    return s if start == 1 else F.substring(s, F.lit(start), F.length(s))


def regexp_count(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(_from(s, start), F.lit(java(pattern, flags)))


def regexp_substr(s: Column, pattern: str, start: int = 1, nth: int = 1, flags: str = "", group: int = 0) -> Column:
    """The n-th match or a group of it; null if there are fewer."""
    return F.get(F.regexp_extract_all(_from(s, start), F.lit(java(pattern, flags)), F.lit(group)), F.lit(nth - 1))


def regexp_instr(s: Column, pattern: str, start: int = 1, nth: int = 1, end: int = 0, flags: str = "") -> Column:
    """Where the n-th match begins, or what follows it (end = 1); 0 if there are fewer."""
    t, p = _from(s, start), java(pattern, flags)
    pieces, found = F.split(t, p, -1), F.regexp_extract_all(t, F.lit(p), F.lit(0))
    size = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))
    at = size(F.slice(pieces, 1, nth)) + size(F.slice(found, 1, nth - 1 + end))
    return F.when(F.size(found) >= nth, at + start).when(s.isNotNull(), F.lit(0))


def like_escape(pattern: str, escape: str) -> str:
    """The pattern with a backslash for its escape character."""
    if escape == "\\":
        return pattern
    if escape == "":
        return pattern.replace("\\", "\\\\")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 2
            continue
        out.append("\\\\" if c == "\\" else c)
        i += 1
    return "".join(out)


def like(s: Column, pattern: str, escape: str = "\\", fold: bool = False) -> Column:
    p = like_escape(pattern, escape)
    return s.ilike(p) if fold else s.like(p)


def similar_to_escape(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern, anchored at both ends."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif inside:
            out.append("\\\\" if c == "\\" else c)
            inside = c != "]"
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "(":
            out.append("(?:")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    return s.rlike("(?s)" + similar_to_escape(pattern, escape))


def substring_similar(s: Column, pattern: str, escape: str) -> Column:
    """The part between the two marks (escape and a double quote) of a pattern that matches the whole text."""
    a, b, c = pattern.split(escape + '"')
    each = [similar_to_escape(x, escape)[1:-1] for x in (a, b, c)]
    p = f"(?s)^{each[0].replace('.*', '.*?')}({each[1]}){each[2]}$"
    return F.when(s.rlike(p), F.regexp_extract(s, p, 1))

