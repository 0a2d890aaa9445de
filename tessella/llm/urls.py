"""URL filter: rules first, and gradient-boosted trees on lexical features for the rest.
DataFrame functions only.

Rules are a list of (verdict, host, path). The trees learn from labelled URLs: those of ``labels``, or else the URLs
that a rule decides. Their features (lengths, depth, digits, entropy, parameters, and how often URLs of the same
suffix are blocked) are counted into bins; blocked and allowed URLs weigh the same in all. Each level of a tree is one
aggregation of gradient sums by node, feature and bin (a table of bounded size), and the finished trees are one column
expression. Gradients are whole numbers, so sums don't depend on the order of rows. Neither the host nor a word of the
path is a feature: what the rules say about those they say already. A suffix that no labelled URL has counts as neutral.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and is allowed, as there is
nothing to judge. If no URL is labelled, or all alike, the rest is allowed. Repeated rows get the same verdict. An empty
table gives an empty table. Columns of the input stay with ``judge``; its own get underscores where taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, lower_ascii, materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: So many labelled URLs train the trees, about, chosen by hash: training is bounded, judging is not.
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, RIDGE = 12, 3, 0.4, 32, 1.0
FIX = 2**20


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        got = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_length(host: Column) -> Column:
    return F.length(F.substring_index(host, ".", -1))


def _count(url: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(url, f"[^{pattern}]", ""))


def entropy(url: Column) -> Column:
    """Bits per character."""
    n = F.length(url).cast("double")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def features(url: Column, host: Column, path: Column, rate: Column) -> dict[str, Column]:
    """Bins (0 to 31) of each feature. ``rate``: blocked share of the host's suffix, classes weighing the same."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    raw = {
        "length": n / 4,
        "host_length": F.length(host) / 2,
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.when(n > 0, _count(u, "0-9") / n * 32).otherwise(0.0),
        "digits": _count(u, "0-9"),
        "entropy": entropy(u) * 5,
        "params": _count(u, "&=") + F.when(u.contains("?"), 1).otherwise(0),
        "labels": F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))),
        "dashes": _count(u, "_-"),
        "plain": F.when(u.startswith("http://"), 1).otherwise(0),
        "path_length": F.length(path) / 2,
        "suffix_length": suffix_length(host),
        "suffix_rate": rate * (BINS - 1),
    }
    return {k: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(v))).cast("int") for k, v in raw.items()}


def _node(tree: dict, at: int = 1) -> Column:
    """The number of the node a row comes to, of those grown so far."""
    if at not in tree:
        return F.lit(at)
    f, b = tree[at]
    return F.when(F.col(f) <= b, _node(tree, 2 * at)).otherwise(_node(tree, 2 * at + 1))


def _leaf(tree: dict, leaves: dict[int, int], at: int = 1) -> Column:
    if at not in tree:
        return F.lit(leaves.get(at, 0)).cast("long")
    f, b = tree[at]
    return F.when(F.col(f) <= b, _leaf(tree, leaves, 2 * at)).otherwise(_leaf(tree, leaves, 2 * at + 1))


def _margin(model: list[tuple[dict, dict]], prior: int) -> Column:
    out = F.lit(prior).cast("long")
    for tree, leaves in model:
        out = out + _leaf(tree, leaves)
    return out


def grow(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> tuple[list[tuple[dict, dict]], int]:
    """Train on (bins ..., blocked, n). What comes to the driver is one sum per node, feature
    and bin: at most 2**depth * features * bins rows."""
    total, pos = rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("blocked"))).first()
    if not total or not pos or pos == total:
        return [], 0
    model: list[tuple[dict, dict]] = []
    weight = F.when(F.col("blocked") == 1, total / 2 / pos).otherwise(total / 2 / (total - pos))
    for _ in range(trees):
        p = 1.0 / (1.0 + F.exp(-_margin(model, 0) / float(FIX)))
        fixed = lambda x: F.round(x * weight * FIX).cast("long") * F.col("n")
        graded = rows.withColumn("__g", fixed(p - F.col("blocked"))).withColumn("__h", fixed(p * (1 - p)))
        tree: dict[int, tuple[str, int]] = {}
        leaves: dict[int, int] = {}
        for level in range(depth):
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names])).alias("x")
            sums = graded.select(_node(tree).alias("node"), "__g", "__h", each).groupBy("node", "x.f", "x.b").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"))
            by: dict[int, dict[str, dict[int, tuple[int, int]]]] = {}
            for node, f, b, g, h in sums.collect():
                if node >= 2**level:  # others ended on a level above
                    by.setdefault(node, {}).setdefault(f, {})[b] = (g, h)
            for node, feats in by.items():
                G, H = (sum(x[i] for x in feats[names[0]].values()) for i in (0, 1))
                leaves[node] = _value(G, H)
                best = _split(feats, names, G, H)
                if best:
                    (f, b), (gl, hl) = best
                    tree[node] = (f, b)
                    leaves[2 * node], leaves[2 * node + 1] = _value(gl, hl), _value(G - gl, H - hl)
            if not any(n in tree for n in by):
                break
        model.append((tree, leaves))
    return model, 0


def _value(g: int, h: int) -> int:
    return round(-RATE * g / (h + RIDGE * FIX) * FIX)


def _split(feats: dict, names: list[str], G: int, H: int):
    score = lambda g, h: g * g / (h + RIDGE * FIX)
    best, most = None, score(G, H) * (1 + 1e-9) + 1
    for f in names:
        g = h = 0
        bins = sorted(feats[f])
        for b, after in zip(bins, bins[1:]):
            g, h = g + feats[f][b][0], h + feats[f][b][1]
            gain = score(g, h) + score(G - g, H - h)
            if gain > most:
                best, most = ((f, (b + after) // 2), (g, h)), gain  # half way between the bins that it parts
    return best


class UrlTrees:
    """The trees, and what they need to know of suffixes."""

    def __init__(self, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> None:
        """``labelled``: url, blocked (0 or 1); about ``max_labelled`` of the rows are used."""
        rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull())
        part = min(1.0, max_labelled / max(1, rows.count()))
        rows = rows.filter(F.xxhash64("url").bitwiseAND((1 << 30) - 1) < part * (1 << 30))
        u = F.col("url")
        rows = rows.select(u.alias("__u"), host_of(u).alias("__host"), path_of(u).alias("__path"), F.col("blocked").cast("int").alias("blocked"))
        rows = materialize(rows.withColumn("__suffix", suffix_of(F.col("__host"))), "labelled").coalesce(1)  # bounded from here on: one task
        n, pos = rows.agg(F.count(F.lit(1)), F.sum("blocked")).first()
        w1, w0 = (n / 2 / pos, n / 2 / (n - pos)) if n and pos and pos < n else (1.0, 1.0)
        # a suffix for each labelled row at most, so within the bound of the sample
        blocked, allowed = F.sum("blocked") * F.lit(w1), F.sum(1 - F.col("blocked")) * F.lit(w0)
        stats = rows.groupBy("__suffix").agg(((blocked + 2) / (blocked + allowed + 4)).alias("__share"))
        self.suffixes = F.broadcast(materialize(stats, "suffixes"))
        feats = self._features()
        self.names = list(feats)
        bins = rows.join(self.suffixes, "__suffix", "left").select(*[v.alias(k) for k, v in feats.items()], "blocked")
        bins = materialize(bins.groupBy(*self.names, "blocked").agg(F.count(F.lit(1)).alias("n")), "bins").coalesce(1)
        self.model, self.prior = grow(bins, self.names)

    def _features(self) -> dict[str, Column]:
        return features(F.col("__u"), F.col("__host"), F.col("__path"), F.coalesce(F.col("__share"), F.lit(0.5)))

    def margin(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` (__host among them) and ``__margin`` of (__u, __host, __path, ...): above 0 to be blocked. No host: 0."""
        full = rows.withColumn("__suffix", suffix_of(F.col("__host"))).join(self.suffixes, "__suffix", "left")
        full = full.select(*keep, *[v.alias(f"__f_{k}") for k, v in self._features().items()])
        named = [({at: (f"__f_{f}", b) for at, (f, b) in tree.items()}, leaves) for tree, leaves in self.model]
        return full.select(*keep, F.when(F.col("__host") == "", F.lit(0)).otherwise(_margin(named, self.prior)).alias("__margin"))


def ruled(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """(url, blocked) of the URLs that a rule decides: labels, where there are no others."""
    u = F.col(url)
    marked = pages.select(u.alias("url"), rule_of(host_of(u), path_of(u), rules).alias("r")).filter(F.col("r").isNotNull())
    return marked.select("url", (F.col("r.verdict") == "block").cast("int").alias("blocked"))


def held_out(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """blocked, n, right: of the labelled URLs of a quarter of the hosts, as judged by trees
    that learnt from the other hosts."""
    quarter = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(4)) == 0
    trees = UrlTrees(labelled.filter(~quarter), max_labelled)
    u = F.col("url")
    test = labelled.filter(quarter).select(u.alias("__u"), host_of(u).alias("__host"), path_of(u).alias("__path"), F.col("blocked").cast("int").alias("blocked"))
    right = ((F.col("__margin") > 0).cast("int") == F.col("blocked")).cast("int")
    return trees.margin(test, ["blocked", "__host"]).groupBy("blocked").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the trees' margin for blocking).
    ``labels``: url, blocked; by default those that the rules give."""
    trees = UrlTrees(ruled(pages, url, rules) if labels is None else labels, max_labelled)
    u = F.col(url)
    mine = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "score")}
    # the input's columns travel in one struct, so that no name can clash
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__in"), u.alias("__u"), host_of(u).alias("__host"), path_of(u).alias("__path"))
    full = trees.margin(rows, ["__in", "__path", "__host"]).withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__margin") > 0, "block").otherwise("allow"))
    new = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"), "verdict": verdict, "score": F.col("__margin") / float(FIX)}
    return full.select(*[F.col("__in")[c].alias(c) for c in pages.columns], *[v.alias(mine[k]) for k, v in new.items()])


def op8_urls(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
