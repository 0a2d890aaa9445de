"""Main text of web pages by tag-path ratios.

1. A page is cut into blocks of text, each with its root-to-leaf path of block elements and classes.
2. Text length, punctuation and link text are summed per path and divided by the path's blocks. The ratios of paths
   under one parent are smoothed along the page and fused: length times punctuation times what isn't link text.
   Elements, roles and class or id names of menus, headers, footers, sidebars, notices, adverts, forms and reader
   comments bring a path's ratio to nothing.
3. Paths above a threshold are content. The innermost element that holds most of their text is the container; if an article or
   main element is around it, the outermost of these. Names of the container and of what is around it count for nothing, so that a page
   within one form or one ``page-with-sidebar`` keeps its text.
4. In the container all paths stay, however short their blocks, but for those that names exclude and those that are nothing but links,
   three or more. Outside it a path stays that reaches the threshold; a fifth of it is enough, or a heading, beside
   the container in an element smaller than the body, or in a further article. Beside an article no other path stays.

A name is a whole class or id whose parts all belong to such names (``cookie-notice``, ``siteFooter``), not ``no-sidebar`` or ``related-work``.

Defined results: null or empty html gives an empty text; markup cut off at the end of a page is
dropped and unclosed elements end with it; repeated rows give equal texts; an empty table gives
an empty table. Columns of the input stay; ``text`` and ``n_chars`` get underscores where taken.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import free_name

#: Of the best path's fused ratio: what is below isn't content; beside the container a part of it is enough.
SHARE, NEAR = 0.25, 0.2
#: The container is the innermost element with such a part of the content's text.
MOST = 0.6

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|template|noscript|iframe|svg|math|textarea|title)\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BREAKS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
#: An element of the key ends open ones of the set, up to an element of the list that bounds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
_OUT = frozenset("nav header footer aside form fieldset button select option datalist dialog menu head object applet canvas audio video map search".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names: a name is out if all its parts are of these lists, and one at least of the first.
_OUT_NAMES = frozenset(
    "nav navbar navigation menu menus header masthead footer foot sidebar sidebars aside ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts disclaimer comment comments commentlist replies disqus respond share sharing social related recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login popup popups modal overlay pagination pager toolbar widget widgets copyright outbrain taboola".split()
)
_OUT_PARTS = frozenset("a area bar block blocks bottom box buttons container content end form global group inner item items left link links list main media message mobile outer page panel post posts primary right row secondary section side site skip slot small text thread title top unit user wrap wrapper".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^A-Za-z0-9_:-]+")
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are never the container.
_LEAVES = _HEADING | frozenset("p li dt dd td th tr tbody thead tfoot caption table ul ol dl blockquote pre figure figcaption address center summary".split())


class _Element:
    __slots__ = ("tag", "up", "path", "out", "main", "mass")

    def __init__(self, tag: str, up: _Element | None, label: str, out: bool, main: bool) -> None:
        self.tag, self.up, self.out, self.main, self.mass = tag, up, out, main, 0.0
        self.path = (*(up.path if up else ()), label)


def named_out(names: str) -> bool:
    for name in names.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if any(x in _OUT_NAMES for x in parts) and all(x in _OUT_NAMES or x in _OUT_PARTS for x in parts):
            return True
    return False


def blocks(page: str) -> list[tuple[_Element | None, str, int]]:
    """(innermost block element, text, characters of it in links) of every block of text."""
    out: list[tuple[_Element | None, str, int]] = []
    stack: list[_Element] = []
    parts: list[str] = []
    link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += link and len(parts[-1])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[2] or m[5])
        if tag == "a":
            link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if closing:
            if tag not in _BLOCK and tag not in _OUT:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    flush()
                    del stack[i:]
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in _VOID or (tag not in _BLOCK and tag not in _OUT):
            continue
        flush()
        link = False
        if tag in _BREAKS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "button", "object", "caption"):
                    break
        if tag in _ENDS:
            ends, bound = _ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in bound:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag == "body":
            stack[:] = [e for e in stack if e.tag != "head"]
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[4] or m[7] or "")}
        role = attrs.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        gone = tag in _OUT or role in _OUT_ROLE
        if not gone and tag not in ("html", "body"):
            gone = named_out(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        label = tag + "".join(f".{c}" for c in attrs.get("class", "").split()[:2]) + ("!" if gone else "")
        stack.append(_Element(tag, stack[-1] if stack else None, label, gone, main))
    if at < len(page):
        parts.append(page[at:])
        linked += link and len(parts[-1])
    flush()
    return out


def _chain(e: _Element | None) -> list[_Element]:
    """The element and what is around it, from the inside."""
    out = []
    while e:
        out.append(e)
        e = e.up
    return out


class _Path:
    __slots__ = ("blocks", "chars", "marks", "linked", "score")

    def __init__(self) -> None:
        self.blocks = self.chars = self.marks = self.linked = 0
        self.score = 0.0


def _smooth(values: list[float]) -> list[float]:
    """Along the page, with weights 1 2 1."""
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * values[i] + values[min(n - 1, i + 1)]) / 4 for i in range(n)]


def path_ratios(found: list[tuple[_Element | None, str, int]]) -> dict[tuple, _Path]:
    """The fused ratio of every path, without regard to names."""
    paths: dict[tuple, _Path] = {}
    for e, text, linked in found:
        x = paths.setdefault(e.path if e else (), _Path())
        x.blocks += 1
        x.chars += len(text)
        x.marks += len(_PUNCT.findall(text))
        x.linked += linked
    under = defaultdict(list)
    for key, x in paths.items():
        under[key[:-1]].append(x)
    for group in under.values():
        length, marks = _smooth([x.chars / x.blocks for x in group]), _smooth([x.marks / x.blocks for x in group])
        for x, a, b in zip(group, length, marks):
            x.score = a * (1 + b) * ((1 - x.linked / x.chars) ** 2 + 0.02)
    return paths


def content(found: list[tuple[_Element | None, str, int]], share: float = SHARE) -> list[str]:
    """The texts of the blocks that are content."""
    paths = path_ratios(found)
    chains = [_chain(e) for e, _, _ in found]
    key = lambda i: found[i][0].path if found[i][0] else ()
    plain = [not any(e.out for e in c) for c in chains]
    top = max((paths[key(i)].score for i in range(len(found)) if plain[i]), default=0.0)
    named = not top  # everything lies in elements with such names: the best of them counts
    if named:
        top = max(x.score for x in paths.values())
    # the container: where most of the text of content paths is
    roots: list[_Element] = []
    inside: dict[int, list[_Element]] = defaultdict(list)
    seen: set[int] = set()
    whole = 0.0
    for i, (_, text, linked) in enumerate(found):
        mass = (len(text) - 0.98 * linked) * (1.0 if paths[key(i)].score >= share * top else 0.05) * (1.0 if plain[i] else 0.05)
        whole += mass
        for e in chains[i]:
            e.mass += mass
            if id(e) not in seen:
                seen.add(id(e))
                (inside[id(e.up)] if e.up else roots).append(e)
    box: _Element | None = None
    while True:
        best = max(inside[id(box)] if box else roots, key=lambda e: e.mass, default=None)
        if best is None or best.mass < MOST * whole or best.tag in _LEAVES:
            break
        box = best
    around = _chain(box)
    mains = [e for e in around if e.main]
    if mains:
        box = mains[-1]
        around = _chain(box)
    free = {id(e) for e in around}
    beside = {id(e) for e in around if e is not box and e.tag not in ("html", "body")}
    out = []
    for i, (e, text, _) in enumerate(found):
        x, chain = paths[key(i)], chains[i]
        own = [c for c in chain if id(c) not in free]
        within = box is None or box in chain
        heading = e is not None and e.tag in _HEADING
        # a header within the container is the article's own, of which the headings are taken
        if any(c.out and not (within and heading and c.tag == "header") for c in own):
            continue
        if within:
            keep = heading or x.blocks < 3 or x.linked < 0.9 * x.chars or (e is not None and e.tag == "p")
        elif any(c.main for c in own) or any(id(c) in beside for c in chain):
            keep = heading or x.score >= share * NEAR * top
        else:
            keep = not mains and x.score >= share * top
        if keep:
            out.append(text)
    return out


def extract(page: str | None, share: float = SHARE) -> str:
    """The main text: content blocks in page order, two line feeds between them."""
    found = blocks(page or "")
    return "\n\n".join(content(found, share)) if found else ""


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    names = [free_name(pages, "text"), free_name(pages, "n_chars")]
    schema = T.StructType([*pages.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])
    at = pages.columns.index(html_column)

    def run(batches):
        for batch in batches:
            text = [extract(p) for p in batch.column(at).cast(pa.string()).to_pylist()]
            cols = [*batch.columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns]).mapInArrow(run, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
