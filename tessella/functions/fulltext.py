"""Full-text search: vectors of lexemes with positions, queries, ranking, highlights.

A vector is a text such as ``'cat':3 'fat':2A,4``: lexemes in order, positions up to 16383 with weights A to C (D is
not written). Functions work on Arrow batches; the core is Python.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.base import BOOL, DOUBLE, INT, STRING, STRINGS, rowwise
from tessella.functions.stemmer import stem

#: English words that carry no meaning.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
MAX_POSITION = 16383
WEIGHTS = (0.1, 0.2, 0.4, 1.0)

_TYPES = (("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), ("url", r"(?:[\w-]+\.)+[a-z]{2,}/[^\s<>\"']*"), ("host", r"(?:[\w-]+\.)+[a-z]{2,}(?![\w])"), ("version", r"\d+\.\d+(?:\.\d+)+"), ("float", r"[+-]?\d+\.\d+(?:[eE][+-]?\d+)?"), ("int", r"[+-]?\d+(?![\w])"), ("numhword", r"\w+(?:-\w+)+"), ("tag", r"</?[A-Za-z][^>]*>"), ("entity", r"&(?:#\d+|\w+);"), ("numword", r"(?=\w*\d)\w*[^\W\d_]\w*|\d\w*"), ("asciiword", r"[A-Za-z]+"), ("word", r"[^\W_]+"), ("blank", r"[\W_]+?(?=\w|[<&+-]|$)|[\W_]"))
_PARSE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TYPES))


def parse(text: str) -> list[tuple[str, str]]:
    """(type, token) of a text; a compound gives itself and then its parts."""
    out = []
    for m in _PARSE.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "numhword":
            parts = token.split("-")
            ascii_, digits = token.isascii(), any(c.isdigit() for c in token)
            kind = "numhword" if digits else "asciihword" if ascii_ else "hword"
            out.append((kind, token))
            for i, p in enumerate(parts):
                if i:
                    out.append(("blank", "-"))
                out.append(("hword_numpart" if any(c.isdigit() for c in p) else "hword_asciipart" if p.isascii() else "hword_part", p))
        else:
            out.append((kind, token))
    return out


def lexeme(token: str, config: str = "english") -> str | None:
    """The lexeme of a word, None of a stop word."""
    w = token.lower()
    if config == "simple":
        return w
    if w in STOP:
        return None
    return stem(w) if w.isalpha() or "-" in w else w


def to_vector(text: str, config: str = "english") -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    at = 0
    for kind, token in parse(text):
        if kind in ("blank", "tag", "entity"):
            continue
        at += 1
        x = lexeme(token, config)
        if x is not None and len(out.setdefault(x, [])) < 255:
            out[x].append((min(at, MAX_POSITION), "D"))
    return out


def _order(x: str) -> bytes:
    return x.encode()


def show(v: dict) -> str:
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"
    mark = lambda p: f"{p[0]}{'' if p[1] == 'D' else p[1]}"
    return " ".join(quote(x) + (":" + ",".join(map(mark, sorted(v[x]))) if v[x] else "") for x in sorted(v, key=_order))


_ENTRY = re.compile(r"('(?:[^'\\]|''|\\.)*'|[^\s:]+)(?::([\d,ABCDabcd]+))?")


@functools.lru_cache(4096)
def _read(s: str) -> tuple:
    out: dict[str, list[tuple[int, str]]] = {}
    for x, places in _ENTRY.findall(s):
        x = re.sub(r"\\(.)", r"\1", x[1:-1].replace("''", "'")) if x[0] == "'" else x
        have = out.setdefault(x, [])
        for p in filter(None, places.split(",")):
            n = int(re.match(r"\d+", p)[0])
            have.append((min(n, MAX_POSITION), p[-1].upper() if p[-1].isalpha() else "D"))
    return tuple((k, tuple(sorted(set(v)))) for k, v in out.items())


def read(s: str) -> dict[str, list[tuple[int, str]]]:
    return {k: list(v) for k, v in _read(s)}


# -- queries: None, ("lex", word, weights, prefix), ("!", q), ("&", a, b), ("|", a, b), ("<->", n, a, b) ----


class QueryError(ValueError):
    pass


_QTOKEN = re.compile(r"\s*(?:(<->|<\d+>)|([&|!()])|('(?:[^'\\]|''|\\.)*'|[^\s&|!()<:]+)(?::([A-Da-d*]+))?)")


def _phrase(words: list, flags: str, prefix: bool):
    out, gap = None, 1
    for w in words:
        if w is None:
            gap += 1
            continue
        leaf = ("lex", w, flags, prefix)
        out = leaf if out is None else ("<->", gap, out, leaf)
        gap = 1
    return out


def parse_query(text: str, config: str | None = "english"):
    """``config`` None: lexemes are taken as they are."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _QTOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"syntax error in tsquery: {text!r}")
        tokens.append(m.groups())
        at = m.end()
    i = 0

    def operand():
        nonlocal i
        if i >= len(tokens):
            raise QueryError(f"no operand in tsquery: {text!r}")
        op, sign, word, flags = tokens[i]
        i += 1
        if sign == "!":
            return _not(operand())
        if sign == "(":
            q = either()
            if i >= len(tokens) or tokens[i][1] != ")":
                raise QueryError(f"syntax error in tsquery: {text!r}")
            i += 1
            return q
        if word is None:
            raise QueryError(f"syntax error in tsquery: {text!r}")
        if word[0] == "'":
            word = re.sub(r"\\(.)", r"\1", word[1:-1].replace("''", "'"))
        flags = (flags or "").upper()
        weights, prefix = "".join(sorted(set(flags) - {"*"})), "*" in flags
        if config is None:
            return ("lex", word, weights, prefix)
        return _phrase([lexeme(t, config) for k, t in parse(word) if k not in ("blank", "tag", "entity")], weights, prefix)

    def phrase():
        nonlocal i
        q = operand()
        while i < len(tokens) and tokens[i][0]:
            n = 1 if tokens[i][0] == "<->" else int(tokens[i][0][1:-1])
            i += 1
            q = _follow(n, q, operand())
        return q

    def both():
        nonlocal i
        q = phrase()
        while i < len(tokens) and tokens[i][1] == "&":
            i += 1
            q = _join("&", q, phrase())
        return q

    def either():
        nonlocal i
        q = both()
        while i < len(tokens) and tokens[i][1] == "|":
            i += 1
            q = _join("|", q, both())
        return q

    if not tokens:
        return None
    q = either()
    if i != len(tokens):
        raise QueryError(f"syntax error in tsquery: {text!r}")
    return q


def _not(q):
    return None if q is None else ("!", q)


def _join(op, a, b):
    return b if a is None else a if b is None else (op, a, b)


def _follow(n, a, b):
    return b if a is None else a if b is None else ("<->", n, a, b)


def plain_query(text: str, config: str = "english"):
    q = None
    for k, t in parse(text):
        if k not in ("blank", "tag", "entity"):
            x = lexeme(t, config)
            q = _join("&", q, None if x is None else ("lex", x, "", False))
    return q


def phrase_query(text: str, config: str = "english"):
    return _phrase([lexeme(t, config) for k, t in parse(text) if k not in ("blank", "tag", "entity")], "", False)


def web_query(text: str, config: str = "english"):
    """Quotes for phrases, or, a dash for not; never an error."""
    q, op, no = None, "&", False
    for quoted, word in re.findall(r'"([^"]*)"|((?:-(?=\S))?[^\s"]+)', text):
        if not quoted and not word:
            continue
        if word == "-" or (word and not re.search(r"\w", word)):
            no = word.endswith("-")
            continue
        if word.lower() == "or" and q is not None:
            op = "|"
            continue
        if word.startswith("-"):
            no, word = True, word[1:]
        x = phrase_query(quoted, config) if quoted else phrase_query(word, config)
        x = _not(x) if no else x
        if op == "|" and x is not None and isinstance(q, tuple) and q[0] == "&":
            q = ("&", q[1], ("|", q[2], x))
        else:
            q = _join(op, q, x)
        op, no = "&", False
    return q


_RANK = {"|": 1, "&": 2, "<->": 3, "!": 4, "lex": 5}


def show_query(q, above: int = 0) -> str:
    if q is None:
        return ""
    if q[0] == "lex":
        flags = ("*" if q[3] else "") + q[2]
        return "'" + q[1].replace("\\", "\\\\").replace("'", "''") + "'" + (f":{flags}" if flags else "")
    if q[0] == "!":
        inner = q[1]
        return "!" + (show_query(inner) if inner[0] in ("lex", "!") else f"( {show_query(inner)} )")
    rank = _RANK[q[0]]
    if q[0] == "<->":
        op = "<->" if q[1] == 1 else f"<{q[1]}>"
        text = f"{show_query(q[2], rank)} {op} {show_query(q[3], rank + 1)}"
    else:
        text = f"{show_query(q[1], rank)} {q[0]} {show_query(q[2], rank)}"
    return f"( {text} )" if rank < above else text


def _places(q, v: dict) -> set[int] | None:
    """Where a word or phrase ends; None if the query isn't one."""
    if q[0] == "lex":
        out = set()
        for x in ([k for k in v if k.startswith(q[1])] if q[3] else [q[1]] if q[1] in v else []):
            out |= {p for p, w in v[x] if not q[2] or w in q[2]}
        return out
    if q[0] == "<->":
        a, b = _places(q[2], v), _places(q[3], v)
        if q[3][0] == "!":
            inner = _places(q[3][1], v)
            return {p + q[1] for p in a or () if p + q[1] not in inner}
        if q[2][0] == "!":
            inner = _places(q[2][1], v)
            return {p for p in b or () if p - q[1] not in inner}
        return {p + q[1] for p in a if p + q[1] in b}
    if q[0] == "|":
        return _places(q[1], v) | _places(q[2], v)
    if q[0] == "&":
        return _places(q[1], v) & _places(q[2], v)
    return set()


def match(v: dict, q) -> bool:
    if q is None:
        return False
    if q[0] == "lex":
        names = [k for k in v if k.startswith(q[1])] if q[3] else [q[1]] if q[1] in v else []
        return any(not q[2] or any(w in q[2] for _, w in v[x]) for x in names)
    if q[0] == "!":
        return not match(v, q[1])
    if q[0] == "&":
        return match(v, q[1]) and match(v, q[2])
    if q[0] == "|":
        return match(v, q[1]) or match(v, q[2])
    return bool(_places(q, v))


def _leaves(q) -> list:
    if q is None:
        return []
    if q[0] == "lex":
        return [q]
    return [x for part in q[1:] if isinstance(part, tuple) for x in _leaves(part)]


def _entries(v: dict, q) -> list[list[tuple[int, str]]]:
    """Positions for each distinct lexeme of the query."""
    out = []
    for leaf in dict.fromkeys(_leaves(q)):
        names = [k for k in v if k.startswith(leaf[1])] if leaf[3] else [leaf[1]] if leaf[1] in v else []
        places = [p for n in names for p in (v[n] or [(MAX_POSITION - 1, "D")]) if not leaf[2] or p[1] in leaf[2]]
        if places:
            out.append(sorted(places))
    return out


def _weight(w: str, weights) -> float:
    return weights["DCBA".index(w)]


def _rank_or(entries, n_items: int, weights) -> float:
    total = 0.0
    for places in entries:
        ws = [_weight(w, weights) for _, w in places]
        top = max(range(len(ws)), key=lambda i: (ws[i], -i))
        total += (sum(x / (i + 1) ** 2 for i, x in enumerate(ws)) + ws[top] - ws[top] / (top + 1) ** 2) / 1.64493406685
    return total / n_items if n_items else 0.0


def rank(v: dict, q, weights=WEIGHTS, normalization: int = 0) -> float:
    """By frequency of the lexemes, and by their nearness where the query asks for all of them."""
    if q is None or not v:
        return 0.0
    n_items = len(dict.fromkeys(_leaves(q)))
    entries = _entries(v, q)
    if q[0] in ("&", "<->") and n_items > 1:
        res = -1.0
        for i in range(len(entries)):
            for k in range(i):
                for pa, wa in entries[i]:
                    for pb, wb in entries[k]:
                        d = abs(pa - pb) or (MAX_POSITION if MAX_POSITION - 1 in (pa, pb) else 0)
                        if not d:
                            continue
                        near = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                        x = math.sqrt(_weight(wa, weights) * _weight(wb, weights) * near)
                        res = x if res < 0 else 1 - (1 - res) * (1 - x)
        score = 1e-20 if res < 0 else res
    else:
        score = _rank_or(entries, n_items, weights)
    return _normalize(score, v, normalization)


def _normalize(score: float, v: dict, normalization: int, extent: float | None = None) -> float:
    n = sum(max(len(p), 1) for p in v.values())
    if normalization & 1:
        score /= math.log2(n + 1)
    if normalization & 2:
        score /= n
    if normalization & 4 and extent:
        score /= extent
    if normalization & 8:
        score /= len(v)
    if normalization & 16:
        score /= math.log2(len(v) + 1)
    if normalization & 32:
        score /= score + 1
    return score


def rank_cd(v: dict, q, weights=WEIGHTS, normalization: int = 0) -> float:
    """By covers: shortest stretches that satisfy the query."""
    if q is None:
        return 0.0
    words: dict[int, list[tuple[str, str]]] = {}
    for leaf in dict.fromkeys(_leaves(q)):
        for n in [k for k in v if k.startswith(leaf[1])] if leaf[3] else [leaf[1]] if leaf[1] in v else []:
            for p, w in v[n]:
                if not leaf[2] or w in leaf[2]:
                    words.setdefault(p, []).append((n, w))
    at = sorted(words)
    total, dist, count, before = 0.0, 0.0, 0, -1.0
    i = 0
    while i < len(at):
        end = next((e for e in range(i, len(at)) if match(_part(words, at[i : e + 1]), q)), None)
        if end is None:
            break
        start = end
        while not match(_part(words, at[start : end + 1]), q):
            start -= 1
        p, e = at[start], at[end]
        inside = [(x, w) for k in at[start : end + 1] for x, w in words[k]]
        score = len(inside) / sum(1 / _weight(w, weights) for _, w in inside)
        noise = (e - p) - (end - start)
        total += score / (1 + (noise if noise >= 0 else (end - start) / 2))
        middle = (p + e) / 2
        if count and middle > before:
            dist += 1 / (middle - before)
        before = middle
        count += 1
        i = start + 1
    return _normalize(total, v, normalization, count / dist if dist else None)


def _part(words: dict, at: list[int]) -> dict:
    out: dict[str, list[tuple[int, str]]] = {}
    for p in at:
        for x, w in words[p]:
            out.setdefault(x, []).append((p, w))
    return out


def headline(text: str, q, config: str = "english", start: str = "<b>", stop: str = "</b>", max_words: int = 35, min_words: int = 15, short: int = 3, highlight_all: bool = False) -> str:
    """The stretch that holds most of the query's words, these marked."""
    leaves = _leaves(q)
    hit = lambda t: (x := lexeme(t, config)) is not None and any(x.startswith(f[1]) if f[3] else x == f[1] for f in leaves)
    tokens = [(k, t, k not in ("blank", "tag", "entity") and hit(t)) for k, t in parse(text)]
    words = [i for i, (k, _, _) in enumerate(tokens) if k not in ("blank", "tag", "entity")]
    lo, hi = 0, len(tokens)
    if not highlight_all and len(words) > max_words:
        found = [n for n, i in enumerate(words) if tokens[i][2]]
        best = max(found, key=lambda n: (sum(n <= m < n + max_words for m in found), -n), default=0)
        last = max((m for m in found if best <= m < best + max_words), default=best + min_words - 1)
        first = best
        if last - first + 1 < min_words:
            last = min(first + min_words - 1, len(words) - 1)
        while last < len(words) - 1 and last - first + 1 < max_words and len(tokens[words[last]][1]) <= short:
            last += 1
        lo, hi = words[first], words[last] + 1
    return "".join(f"{start}{t}{stop}" if h else t for _, t, h in tokens[lo:hi])


def _rewrite(q, old, new):
    if q is None or old is None:
        return q
    if q == old:
        return new
    if q[0] in ("&", "|") and old[0] == q[0]:
        flat, want = _flat(q, q[0]), _flat(old, q[0])
        if all(w in flat for w in want):
            rest = [x for x in flat if x not in want]
            parts = [_rewrite(x, old, new) for x in rest] + ([new] if new is not None else [])
            out = None
            for p in parts:
                out = _join(q[0], out, p)
            return out
    if q[0] == "lex":
        return q
    if q[0] == "!":
        return _not(_rewrite(q[1], old, new))
    if q[0] == "<->":
        return _follow(q[1], _rewrite(q[2], old, new), _rewrite(q[3], old, new))
    a, b = _rewrite(q[1], old, new), _rewrite(q[2], old, new)
    return _join(q[0], b, a) if a != q[1] and b == q[2] else _join(q[0], a, b)  # what is new comes last


def _flat(q, op) -> list:
    return _flat(q[1], op) + _flat(q[2], op) if q[0] == op else [q]


def _querytree(q):
    """What an index can serve: without negations."""
    if q is None or q[0] == "!":
        return None
    if q[0] == "lex":
        return q
    if q[0] == "<->":
        return _join("&", _querytree(q[2]), _querytree(q[3]))
    a, b = _querytree(q[1]), _querytree(q[2])
    return None if q[0] == "|" and (a is None or b is None) else _join(q[0], a, b)


def _nodes(q) -> int:
    return 0 if q is None else 1 if q[0] == "lex" else 1 + sum(_nodes(x) for x in q[1:] if isinstance(x, tuple))


def _concat(a: dict, b: dict) -> dict:
    shift = max((p for ps in a.values() for p, _ in ps), default=0)
    out = {k: list(v) for k, v in a.items()}
    for k, v in b.items():
        out[k] = out.get(k, []) + [(min(p + shift, MAX_POSITION), w) for p, w in v]
    return out


# -- Columns ------------------------------------------------------------------------------------


def to_tsvector(s: Column, config: str = "english") -> Column:
    return rowwise(lambda s: show(to_vector(s, config)), STRING)(s)


tsvector = rowwise(lambda s: show(read(s)), STRING)
array_to_tsvector = rowwise(lambda a: show({x: [] for x in a}), STRING)
tsvector_to_array = rowwise(lambda s: sorted(read(s), key=_order), STRINGS)
length = rowwise(lambda s: len(read(s)), INT)
strip = rowwise(lambda s: show({k: [] for k in read(s)}), STRING)
concat = rowwise(lambda a, b: show(_concat(read(a), read(b))), STRING)
ts_delete = rowwise(lambda s, x: show({k: v for k, v in read(s).items() if k not in (x if isinstance(x, list) else [x])}), STRING)
ts_filter = rowwise(lambda s, ws: show({k: p for k, v in read(s).items() if (p := [x for x in v if x[1].lower() in [w.lower() for w in ws]])}), STRING)


def setweight(s: Column, weight: str, lexemes: list[str] | None = None) -> Column:
    return rowwise(lambda s: show({k: [(p, weight if lexemes is None or k in lexemes else w) for p, w in v] for k, v in read(s).items()}), STRING)(s)


UNNEST = T.ArrayType(T.StructType([T.StructField("lexeme", STRING), T.StructField("positions", T.ArrayType(INT)), T.StructField("weights", STRINGS)]))
unnest = rowwise(lambda s: [{"lexeme": k, "positions": [p for p, _ in v], "weights": [w for _, w in v]} for k, v in sorted(read(s).items())], UNNEST)


def to_tsquery(s, config: str = "english") -> Column:
    return rowwise(lambda s: show_query(parse_query(s, config)), STRING)(s)


def plainto_tsquery(s, config: str = "english") -> Column:
    return rowwise(lambda s: show_query(plain_query(s, config)), STRING)(s)


def phraseto_tsquery(s, config: str = "english") -> Column:
    return rowwise(lambda s: show_query(phrase_query(s, config)), STRING)(s)


def websearch_to_tsquery(s, config: str = "english") -> Column:
    return rowwise(lambda s: show_query(web_query(s, config)), STRING)(s)


tsquery = rowwise(lambda s: show_query(parse_query(s, None)), STRING)
q_and = rowwise(lambda a, b: show_query(_join("&", parse_query(a, None), parse_query(b, None))), STRING)
q_or = rowwise(lambda a, b: show_query(_join("|", parse_query(a, None), parse_query(b, None))), STRING)
q_not = rowwise(lambda a: show_query(_not(parse_query(a, None))), STRING)
numnode = rowwise(lambda q: _nodes(parse_query(q, None)), INT)
querytree = rowwise(lambda q: show_query(_querytree(parse_query(q, None))) or "T", STRING)
ts_rewrite = rowwise(lambda q, a, b: show_query(_rewrite(parse_query(q, None), parse_query(a, None), parse_query(b, None))), STRING)


def tsquery_phrase(a, b, n: int = 1) -> Column:
    return rowwise(lambda a, b: show_query(_follow(n, parse_query(a, None), parse_query(b, None))), STRING)(a, b)


matches = rowwise(lambda v, q: match(read(v), parse_query(q, None)), BOOL)  # v @@ q
q_contains = rowwise(lambda a, b: {x[1] for x in _leaves(parse_query(b, None))} <= {x[1] for x in _leaves(parse_query(a, None))}, BOOL)


def ts_rank(v, q, weights=WEIGHTS, normalization: int = 0) -> Column:
    return rowwise(lambda v, q: rank(read(v), parse_query(q, None), weights, normalization), DOUBLE)(v, q)


def ts_rank_cd(v, q, weights=WEIGHTS, normalization: int = 0) -> Column:
    return rowwise(lambda v, q: rank_cd(read(v), parse_query(q, None), weights, normalization), DOUBLE)(v, q)


def ts_headline(s, q, config: str = "english", **options) -> Column:
    return rowwise(lambda s, q: headline(s, parse_query(q, None), config, **options), STRING)(s, q)


TOKENS = T.ArrayType(T.StructType([T.StructField("position", INT), T.StructField("type", STRING), T.StructField("token", STRING), T.StructField("lexeme", STRING)]))


def ts_parse(s, config: str = "english", blanks: bool = True) -> Column:
    """Array of tokens with their types and lexemes; ``inline`` it. Positions count what isn't blank."""

    def f(s):
        out, at = [], 0
        for k, t in parse(s):
            word = k not in ("blank", "tag", "entity")
            at += word
            if word or blanks:
                out.append({"position": at if word else None, "type": k, "token": t, "lexeme": lexeme(t, config) if word else None})
        return out

    return rowwise(f, TOKENS)(s)


def ts_token_types() -> list[str]:
    return [n for n, _ in _TYPES]


ts_lexize = rowwise(lambda w: [] if w.lower() in STOP else [stem(w.lower())], STRINGS)


def ts_stat(df, vector: str):
    """word, ndoc, nentry over all vectors of a table."""
    each = df.select(F.inline(unnest(F.col(vector))))
    return each.groupBy(F.col("lexeme").alias("word")).agg(F.count(F.lit(1)).alias("ndoc"), F.sum(F.size("positions")).alias("nentry"))
