"""Quality rules: isolation forests on rule statistics.

Each text gives a few statistics, in groups (symbols, stutter, repeats, lengths, all). For each group an
isolation forest, grown on all rows that pass the fixed limits, scores how soon random splits set a
document apart. The threshold of each group is the one that best parts labelled good rows from
labelled bad ones while it rejects few good ones; a group that can't tell them apart gets a
threshold that nothing exceeds. Fixed limits (too short, too repetitive) reject regardless.
A forest over all statistics at once would find rare good rows (long, or with a refrain) odder
than junk of a common kind; that is why there are groups.

No row is left out: rows are dealt to the trees by a hash of id and text, each to as many that a tree has ``PSI`` rows or
more, to at least one of every forest, and to all while there are ``PSI`` rows or fewer. Trees grow level by level where the rows are; the driver gets the count
and the ranges of each open node, of which there are ``TREES`` times ``PSI`` a group at most, and draws the cuts. Thresholds are set on every labelled row,
from counts of good and bad rows by score in steps of 1 / ``GRID``; every document is scored over its whole text.

Defined results: null or empty text has no words and fails; repeated rows get equal
verdicts, and each counts where its id has a label (the least, if several); where labels are missing or of one kind the thresholds are ``DEFAULT_CUT``; an empty table gives an
empty table. Columns of the input stay with ``annotate``, whose own are suffixed where taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import textvec
from tessella.llm.common import discard, free_name, materialize

TREES, PSI, SEED = 128, 256, 7
#: Steps in which scores are counted.
GRID = 1 << 16
#: The share of labelled good rows that the threshold may cost.
MOST_LOST = 0.005
DEFAULT_CUT, NEVER = 0.75, 2.0
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_next")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """STATS of one text; n_same_next counts words equal to the one before."""
    text = text or b""
    h, s, e = textvec.words(text)
    b = np.frombuffer(text, np.uint8)
    chars = symbols = 0
    for at in range(0, len(b), textvec.SEGMENT):
        seg = b[at : at + textvec.SEGMENT]
        chars += int(np.count_nonzero(((seg & 0xC0) != 0x80) & ~textvec._SPACE[seg]))
        symbols += int(np.count_nonzero(_SYMBOL[seg]))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(h), chars, symbols, len(lines) - len(set(lines)), _repeated(h), int(np.count_nonzero(h[1:] == h[:-1]))


def _repeated(h: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    w = textvec.windows(h, WINDOW)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1]) > 0))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


#: Columns of ``features`` by group.
GROUPS = {"symbols": (1, 2), "stutter": (6, 4), "repeats": (3, 4), "lengths": (0, 5), "all": (0, 1, 2, 3, 4, 5, 6)}


def features(stats: np.ndarray) -> np.ndarray:
    """From rows of STATS: word length, symbols by character and by word, shares of repeated
    lines and repeated words, logarithm of the length, share of words equal to the one before."""
    n, chars, symbols, dup, rep, same = (stats[:, i].astype(float) for i in range(6))
    words = np.maximum(n, 1)
    return np.column_stack([chars / words, symbols / np.maximum(chars, 1), symbols / words, dup / words, rep / words, np.log1p(n), same / words])


def _c(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: feature (-1 at a leaf), cut, first child, depth at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.psi, replace=False)], rng) for _ in range(trees if len(x) else 0)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        feature, cut, child, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            at, rows, d = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            free = np.flatnonzero(high > low)
            if d >= limit or len(rows) < 2 or not len(free):
                depth[at] = d + float(_c(len(rows)))
                continue
            f = int(rng.choice(free))
            c = float(rng.uniform(low[f], high[f]))
            feature[at], cut[at], child[at] = f, c, len(feature)
            left = rows[:, f] <= c
            for part in (rows[left], rows[~left]):
                todo.append((len(feature), part, d + 1))
                feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
        return np.array(feature), np.array(cut), np.array(child), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """1 for rows set apart at once, about 0.5 or less for ordinary ones."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = child[at] + (x[rows, np.maximum(f, 0)] > cut[at])
                at = np.where(inner, go, at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_c(self.psi)), 1e-9))


def calibrate(cells: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float = MOST_LOST) -> float:
    """The cut that rejects the most bad rows beyond the good ones, losing few good ones, from the numbers of
    good and bad rows by cell, in the order of cells. Rows score above the cut to be rejected."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return NEVER
    lost, caught = 1 - np.cumsum(good) / n_good, 1 - np.cumsum(bad) / n_bad
    # a cut is worth setting where it takes bad rows at a clearly higher rate than good ones
    worth = np.where((lost <= most_lost) & (caught >= 20 * lost) & (caught > 0), caught - lost, -1.0)
    i = int(np.argmax(worth))
    if worth[i] < 0:
        return NEVER
    # half way to the next score, so that rows near the cut fall like their neighbours
    return float(cells[i] if i + 1 == len(cells) else (cells[i] + cells[i + 1] - 1) / 2) / GRID


def cells(scores: np.ndarray) -> np.ndarray:
    """Cell i has the scores above (i - 1) / GRID up to i / GRID."""
    return np.ceil(scores * GRID).astype(np.int32)


class Rules:
    """The forests of all groups and their cuts."""

    def __init__(self, forests: dict[str, Forest]) -> None:
        self.forests = forests
        self.cuts = dict.fromkeys(GROUPS, DEFAULT_CUT)

    def scores(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {g: self.forests[g].score(x[:, list(f)]) for g, f in GROUPS.items()}

    def excess(self, x: np.ndarray) -> np.ndarray:
        """The most by which a score exceeds its cut; above 0 to be rejected."""
        if not len(x):
            return np.zeros(0)
        return np.max([s - self.cuts[g] for g, s in self.scores(x).items()], axis=0)


def _stat_batches(batches):
    for batch in batches:
        text = batch.column(2).cast(pa.binary()).to_pylist()
        rows = [text_stats(t) for t in text]
        cols = list(zip(*rows)) if rows else [()] * len(STATS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=["h", "k", *STATS])


_STATS_SCHEMA = "h long, k int, " + ", ".join(f"{s} long" for s in STATS)


def _stats(batch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in STATS])


class Growth:
    """Trees of all groups that grow level by level: feature (-1 at a leaf, -2 at an open node), cut, first child,
    depth at a leaf, tree; the first nodes are the roots, group by group."""

    def __init__(self, n: int, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> None:
        self.n_trees, self.each = trees, min(trees, -(-trees * psi // max(1, n)))
        self.psi = n * self.each / trees
        self.height = int(np.ceil(np.log2(max(2, min(psi, self.psi)))))
        self.rng = np.random.default_rng(seed)
        self.tree = np.arange(trees * len(GROUPS))
        self.feature, self.cut, self.child, self.depth = np.full(len(self.tree), -2), np.zeros(len(self.tree)), np.zeros(len(self.tree), np.int64), np.zeros(len(self.tree))
        self.mine = np.array([[i in f for i in range(7)] for f in GROUPS.values()])

    def reach(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, open node) of every row in every tree that it is dealt to."""
        of = (h[:, None] % self.n_trees + np.arange(self.each)) % self.n_trees
        at = (of[:, :, None] + self.n_trees * np.arange(len(GROUPS))).reshape(-1)
        row = np.repeat(np.arange(len(h)), self.each * len(GROUPS))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            row, at = row[self.feature[at] != -1], at[self.feature[at] != -1]
            f = self.feature[at]
            at = np.where(f >= 0, self.child[at] + (x[row, np.maximum(f, 0)] > self.cut[at]), at)
        still = self.feature[at] == -2
        return row[still], at[still]

    def ranges(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(open nodes, their rows, the least and the most of each feature)."""
        row, at = self.reach(x, h)
        order = np.argsort(at, kind="stable")
        nodes, start, n = np.unique(at[order], return_index=True, return_counts=True)
        if not len(nodes):
            return nodes, n, np.zeros((0, 7)), np.zeros((0, 7))
        held = x[row[order]]
        return nodes, n, np.minimum.reduceat(held, start), np.maximum.reduceat(held, start)

    def step(self, level: int, nodes: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Open nodes become leaves or get a cut and two open children."""
        order = np.argsort(nodes)
        nodes, n, low, high = nodes[order], n[order], low[order], high[order]
        was = np.flatnonzero(self.feature == -2)
        self.feature[was], self.depth[was] = -1, level
        self.depth[nodes] += _c(n)
        free = (high > low) & self.mine[self.tree[nodes] // self.n_trees]
        f = np.argmax(np.where(free, self.rng.random(free.shape), -1.0), 1)
        u = self.rng.random(len(nodes))
        go = np.flatnonzero(free.any(1) & (level < self.height))
        at, f, lo, hi = nodes[go], f[go], low[go, f[go]], high[go, f[go]]
        self.feature[at], self.cut[at] = f, np.minimum(lo + u[go] * (hi - lo), np.nextafter(hi, lo))
        self.depth[at], self.child[at] = 0.0, len(self.feature) + 2 * np.arange(len(at))
        self.tree = np.append(self.tree, np.repeat(self.tree[at], 2))
        for name, value in (("feature", -2), ("cut", 0.0), ("child", 0), ("depth", 0.0)):
            held = getattr(self, name)
            setattr(self, name, np.append(held, np.full(2 * len(at), value, held.dtype)))

    def forests(self) -> dict[str, Forest]:
        order = np.argsort(self.tree, kind="stable")
        first = np.searchsorted(self.tree[order], np.arange(self.n_trees * len(GROUPS) + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - first[self.tree[order]]
        out = {}
        for i, (g, columns) in enumerate(GROUPS.items()):
            local = np.full(8, -1)
            local[list(columns)] = np.arange(len(columns))
            out[g] = forest = Forest(np.zeros((0, len(columns))))
            forest.psi = self.psi
            for t in range(i * self.n_trees, (i + 1) * self.n_trees):
                at = order[first[t] : first[t + 1]]
                forest.trees.append((local[self.feature[at]], self.cut[at], place[self.child[at]], self.depth[at]))
        return out


_RANGES = "node long, n long, " + ", ".join(f"low{i} double, high{i} double" for i in range(7))


def grow(stats: DataFrame, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> dict[str, Forest]:
    """The forest of each group, of all rows of (h, STATS)."""
    n = stats.count()
    g = Growth(n, trees, psi, seed)
    for level in range(g.height + 1 if n else 0):
        held = stats.sparkSession.sparkContext.broadcast(g)

        def run(batches):
            size = len(held.value.feature)
            n, low, high = np.zeros(size, np.int64), np.full((size, 7), np.inf), np.full((size, 7), -np.inf)
            for batch in batches:
                at, count, lo, hi = held.value.ranges(features(_stats(batch)), batch.column(0).to_numpy())
                n[at] += count
                low[at], high[at] = np.minimum(low[at], lo), np.maximum(high[at], hi)
            at = np.flatnonzero(n)
            cols = [at, n[at], *(c[at, i] for i in range(7) for c in (low, high))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in _RANGES.split(", ")])

        least = [e for i in range(7) for e in (F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}"))]
        got = stats.mapInArrow(run, _RANGES).groupBy("node").agg(F.sum("n").alias("n"), *least).toArrow()
        col = {c: got.column(c).to_numpy() for c in got.column_names}
        low, high = (np.column_stack([col[f"{side}{i}"] for i in range(7)]) for side in ("low", "high"))
        g.step(level, col["node"], col["n"], low, high)
        held.unpersist()
    return g.forests() if n else {k: Forest(np.zeros((0, len(f)))) for k, f in GROUPS.items()}


# a bounded sample by hash: fit takes all rows, only a test still calls these two
def _near(df: DataFrame, key: list[str], most: int, n: int) -> DataFrame:
    """``df`` with h, a hash of the key, for those of the ``n`` rows among which the ``most`` least hashes lie, and a few more."""
    near = min(1.0, (most + 6 * most**0.5) / max(1, n))
    return df.withColumn("h", F.pmod(F.xxhash64(*key), F.lit(1 << 30))).filter(F.col("h") <= int(near * (1 << 30)))


def _collected(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, statistics) of the ``most`` rows of (h, k, text) with the least h, in an order that reruns share. Texts
    become statistics where they are; only these are sorted and sent, ``most`` of them at most whatever the rows are."""
    stats = rows.select("h", "k", "text").mapInArrow(_stat_batches, _STATS_SCHEMA)
    got = [tuple(r)[1:] for r in stats.orderBy("h", "k", *STATS).limit(most).collect()]
    return np.array([r[0] for r in got]), np.array([r[1:] for r in got], dtype=np.int64).reshape(-1, len(STATS))


def fit(docs: DataFrame, labels: DataFrame | None, text: str = "text", doc_id: str = "doc_id") -> Rules:
    """The forests and their thresholds. ``labels``: doc_id, quality (1 good, 0 bad)."""
    d = docs.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("text")).select(F.xxhash64("k", "text").alias("h"), "k", "text")
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("k", d.schema["k"].dataType), *[T.StructField(c, T.LongType()) for c in STATS]])
    stats = materialize(d.mapInArrow(_stat_batches, schema), "stats")
    plain = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rules = Rules(grow(plain))
    if labels is not None:
        lab = labels.filter(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg(F.min("quality").alias("quality"))
        set_cuts(rules, plain.join(lab, "k").select((F.col("quality") > 0).alias("good"), *STATS))
    discard(stats)
    return rules


def set_cuts(rules: Rules, known: DataFrame) -> None:
    """The cuts of ``rules`` by all rows of (good, STATS); they stay where all rows are good or none is."""

    def run(batches):
        for batch in batches:
            scores = rules.scores(features(_stats(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(cells(scores[g])) for g in GROUPS]], names=["good", *GROUPS])

    left = scored = materialize(known.mapInArrow(run, "good boolean, " + ", ".join(f"`{g}` int" for g in GROUPS)), "scores")
    for i, g in enumerate(GROUPS):  # a later group is for what the earlier ones let pass
        got = left.groupBy(g).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy(g).toArrow()
        cell, good, bad = (c.to_numpy() for c in got.columns)
        if not i and not (good.sum() and bad.sum()):
            break
        rules.cuts[g] = calibrate(cell, good, bad)
        left = left.filter(F.col(g) <= F.lit(rules.cuts[g] * GRID))
    discard(scored)


def annotate(docs: DataFrame, rules: Rules, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with the statistics, base_failed, score (the excess over
    the nearest threshold) and kept, in one pass."""
    new = [free_name(docs, n) for n in (*STATS, "base_failed", "score", "kept")]
    keep = columns if columns is not None else docs.columns
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in new[:-3]] + [T.StructField(new[-3], T.BooleanType()), T.StructField(new[-2], T.DoubleType()), T.StructField(new[-1], T.BooleanType())])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(free_name(docs, "__text")))

    def run(batches):
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            stats = np.array(rows, np.int64).reshape(-1, len(STATS))
            failed = base_failed(stats[:, 0], stats[:, 4])
            score = rules.excess(features(stats))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array(stats[:, i]) for i in range(len(STATS))] + [pa.array(failed), pa.array(score), pa.array(~failed & (score <= 0))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of ``docs`` that pass, as they were."""
    out = annotate(docs, fit(docs, labels))
    return out.filter(F.col(f"`{out.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return annotate(docs, rules, columns=["doc_id"]).drop("score")
