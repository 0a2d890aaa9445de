"""Near-duplicates by HyperMinHash.

1. Each text gives the set of its k-word shingles. The first bits of a shingle's hash choose
   one of 256 buckets; a bucket stores for its least hash the count of leading zeros and ten mantissa bits.
   Few shingles would leave buckets empty, so a set of up to ``SMALL`` has a hash function of its own for each bucket,
   under which every shingle falls into it: its registers are full and independent however short the text.
   Sets a little larger have both kinds of registers, as they may be similar to a small one.
2. Texts with equal sets are one class; only its least document goes on.
3. Registers are banded; documents that share a band's registers meet in a bucket. Every member is
   compared with the bucket's leader. A collision-corrected estimate of the Jaccard
   similarity drops what is far below the threshold, and the full sets confirm the rest.
4. Buckets whose members are then still in several components hold pairs that nobody has compared: their
   members are gathered in blocks, and blocks of different components are compared register by register,
   then set by set where registers agree. A pair is looked at in its first shared band only, and a pair of
   blocks reports the links that connect it, not all. So no link is lost to step 3, no bucket has
   a cap, and members that are connected already are not compared again.
5. Components of the confirmed links.

With 42 bands of 6 independent registers a pair of similarity 0.85 shares none with probability 2e-9, of 0.8
with 3e-6; the estimate errs by more than its margin of 6 standard deviations with less than 1e-7. Buckets of
sets above ``SMALL`` hold three shingles and more on average, and the 5 % that are empty borrow.

Defined results: null, empty or blank text has an empty set, links with nothing and is kept;
a text of fewer than k words is one shingle; rows that repeat an id are one document; a row with a null id
is linked with nothing, has no component and is kept; ties have no effect, as the least id
is kept; an empty table gives an empty table. Other columns are not read by ``classes`` and stay in ``deduplicate``.
Sets are sets of 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec
from tessella.llm.common import free_name, materialize, split_join
from tessella.llm.components import components

REGISTERS, BANDS, ROWS = 256, 42, 6
MANTISSA = 10
#: Sets of up to so many shingles have a hash function for each register instead of buckets.
SMALL = 768
MARGIN = 6
BLOCK, BLOCK_SHINGLES, LARGE, SPREAD = 256, 500_000, 32, 4
#: A bucket's leader is the member whose id is least after this is put over it, in turns by band, so that a group has several leaders.
_TURNS = (0, 0x2AF7_31C5_9D1B, 0x51D8_CE3A_62E4)
#: Ids of texts to compare are broadcast up to this count (8 bytes each), and joined beyond it.
BROADCAST_IDS = 500_000
_U = np.uint64
#: Registers of a band lie together, but come from buckets far apart.
_ORDER = np.array([j + BANDS * i for j in range(BANDS) for i in range(ROWS)] + list(range(BANDS * ROWS, REGISTERS)))
_SIDE = textvec.mix(np.arange(REGISTERS, dtype=_U)) & _U(1)
_MARK = (textvec.mix(np.arange(REGISTERS, dtype=_U) + _U(10_000)) & _U(0xFFFF)).astype(np.uint16)
_FACTOR = (textvec.mix(np.arange(REGISTERS, dtype=_U) + _U(20_000)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _packed(value: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros of numbers below 2**bits, and mantissa bits behind their first one."""
    part, exponent = np.frexp(value.astype(float))
    zeros = np.where(part > 0, bits - exponent, 63)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (np.maximum(part * 2 - 1, 0) * (1 << MANTISSA)).astype(np.uint16)


def registers(h: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of 64-bit hashes that isn't empty: uint16, in band order."""
    first = np.searchsorted(h, np.arange(REGISTERS, dtype=_U) << _U(56))
    value = h[np.minimum(first, len(h) - 1)]
    full = (first < len(h)) & ((value >> _U(56)) == np.arange(REGISTERS, dtype=_U))
    reg = _packed((value & _U((1 << 56) - 1)) >> _U(3), 53)
    if not full.all():
        at = np.flatnonzero(full)
        place = np.searchsorted(at, np.arange(REGISTERS))
        after, before = at[place % len(at)], at[(place - 1) % len(at)]
        source = np.where(_SIDE == 1, after, before)
        reg = np.where(full, reg, reg[source] ^ _MARK[source])
    return reg[_ORDER]


def own_registers(h: np.ndarray) -> np.ndarray:
    """Registers that each see the whole set, by a hash function of their own."""
    x = (h >> _U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _FACTOR).min(0), out=least)
    return _packed(least, 32)


def expected_collisions(na, nb, own=False):
    """Chance that registers of two disjoint sets agree: equal zeros, then equal mantissas."""
    share = np.where(own, 1, REGISTERS)
    la, lb = (np.asarray(np.asarray(n, float) / share)[..., None] for n in (na, nb))
    z = np.arange(54)
    p = lambda lam: np.exp(-lam * 2.0 ** -(z + 1.0)) - np.exp(-lam * 2.0**-z)
    return (p(np.maximum(la, 1)) * p(np.maximum(lb, 1))).sum(-1) / (1 << MANTISSA)


def estimate(agree, na, nb, own=False):
    c = expected_collisions(na, nb, own)
    return (np.asarray(agree) / REGISTERS - c) / (1 - c)


class NearDuplicates:
    """k-word shingles, similarity of ``percent`` hundredths or more."""

    def __init__(self, k: int = 5, percent: int = 80) -> None:
        self.k, self.percent = k, percent
        t = percent / 100
        self.least_estimate = t - MARGIN * (t * (1 - t) / REGISTERS) ** 0.5
        # a smaller set has no neighbour that isn't equal to it
        self.least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 60
        # no set of up to SMALL shingles is similar to one of more than these
        self.wide = SMALL * 100 // percent

    # -- sketches ----------------------------------------------------------------------------

    def sketches(self, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """id, n (size of the set), f1 and f2 (of the whole set), reg (above SMALL) and own (up to ``wide``) registers."""
        k, least, wide = self.k, self.least, self.wide

        def run(batches):
            for batch in batches:
                ids, out = batch.column(0), []
                for t in batch.column(1).cast(pa.binary()).to_pylist():
                    h = textvec.shingles(t, k)
                    n = len(h)
                    i = np.arange(1, n + 1, dtype=_U)
                    f1 = np.add.reduce(h * (i | _U(1)), dtype=_U)
                    f2 = np.add.reduce(textvec.mix(h + i), dtype=_U)
                    reg = registers(h).tobytes() if n > SMALL else None
                    own = own_registers(h).tobytes() if least <= n <= wide else None
                    out.append((n, int(f1.view(np.int64)), int(f2.view(np.int64)), reg, own))
                n, f1, f2, reg, own = zip(*out) if out else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(reg, pa.binary()), pa.array(own, pa.binary())], names=["id", "n", "f1", "f2", "reg", "own"])

        source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        return source.mapInArrow(run, "id long, n long, f1 long, f2 long, reg binary, own binary")

    # -- candidates --------------------------------------------------------------------------

    def _close(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of (a, b) whose sizes allow the similarity and whose registers suggest it."""
        percent, least = self.percent, self.least_estimate
        side = lambda x: reps.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "reg", "own")])
        full = split_join(split_join(pairs, side("a"), "a"), side("b"), "b")
        full = full.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        # two sets of these sizes have registers of one kind at least; a small set has its own kind only
        own = F.least("na", "nb") <= SMALL
        full = full.select("a", "b", "na", "nb", own.alias("own"), *[F.when(own, F.col(f"own{x}")).otherwise(F.col(f"reg{x}")).alias(f"r{x}") for x in "ab"])

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                get = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                agree = (get("ra") == get("rb")).sum(1)
                na, nb, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb", "own"))
                ok = estimate(agree, na, nb, own) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

        return full.mapInArrow(run, "a long, b long").distinct()

    def _dealt(self, rest: DataFrame) -> DataFrame:
        """(key, band, rep, comp, n) of buckets that hold several components, dealt into blocks of
        about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles: tag, part."""
        weight = F.lit(1 / BLOCK) + F.col("n") / BLOCK_SHINGLES
        per = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum(weight).alias("w"))
        mixed = per.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.when(F.col("m") < LARGE, F.col("w"))).alias("small"), F.sum(F.when(F.col("m") >= LARGE, F.ceil("w"))).alias("large")).filter("lo < hi")
        mixed = mixed.select("key", "small", F.ceil((F.ceil(F.coalesce("small", F.lit(0.0))) + F.coalesce("large", F.lit(0))) / SPREAD).cast("int").alias("spread"))
        # a component with many members in a bucket has blocks of its own, which needn't meet each other
        tags = split_join(per, mixed, "key").select("key", "comp", F.when(F.col("m") >= LARGE, F.col("comp")).alias("tag"), F.ceil(F.when(F.col("m") >= LARGE, F.col("w")).otherwise(F.col("small"))).alias("parts"), "spread")
        tags = tags.select(F.xxhash64("key", "comp").alias("kc"), F.col("key").alias("k2"), F.col("comp").alias("c2"), "tag", "parts", "spread")
        out = split_join(rest.withColumn("kc", F.xxhash64("key", "comp")), tags, "kc").filter("key = k2 and comp = c2")
        return out.select("key", "band", "rep", "comp", "n", "tag", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "spread")

    def _meet(self, dealt: DataFrame, member: list[str]) -> DataFrame:
        """Blocks of a bucket in pairs (and those of small components with themselves): band, xa, xb, ma, mb."""
        blocks = dealt.groupBy("key", "band", "tag", "part", "spread").agg(F.collect_list(F.struct(*member)).alias("m"))
        blocks = materialize(blocks.withColumn("no", F.xxhash64("tag", "part")), "blocks")
        # a bucket of many blocks is spread over tasks: about SPREAD of its blocks meet all of them in one
        x = blocks.select("key", F.pmod("no", "spread").cast("int").alias("salt"), "band", F.col("tag").alias("ta"), F.col("no").alias("xa"), F.col("m").alias("ma"))
        y = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.col("tag").alias("tb"), F.col("no").alias("xb"), F.col("m").alias("mb"))
        meet = x.repartition("key", "salt").join(y.repartition("key", "salt"), ["key", "salt"]).filter("(xa < xb and not coalesce(ta = tb, false)) or (xa = xb and ta is null)")
        return meet.select("key", "band", "xa", "xb", "ma", "mb")

    def _not_lonely(self, rest: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """Memberships of buckets with several components, but for those of sets of which too many
        shingles are in no other set: what is left of such a set can't be similar to anything."""
        k, percent = self.k, self.percent
        mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        rest = materialize(split_join(rest, mixed, "key"), "mixed")
        texts = self._texts(rest.select(F.col("rep").alias("id")).distinct(), docs, text, doc_id)

        def each(batches):
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    h = textvec.shingles(t, k)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i, np.int64))], names=["h", "id"])

        once = texts.mapInArrow(each, "h long, id long").groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep = last")
        own = once.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
        kept = split_join(rest, own, "rep", "left").filter(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
        return materialize(kept.select("key", "band", "rep", "comp", "n"), "rest")

    def _left(self, met: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """Links between different components of a bucket that its leader hasn't settled.

        Registers meet first, and name the members that have a candidate in another component at
        all; then the texts of those meet, and each pair of blocks gives the links that
        connect what it hasn't connected yet: fewer than it has members."""
        k, percent, least = self.k, self.percent, self.least_estimate
        rest = met.filter("size > 2 and rep <> leader").select("key", "band", "rep")
        rest = split_join(rest, comp.select(F.col("v").alias("rep"), "c"), "rep", "left").select("key", "band", "rep", F.coalesce("c", "rep").alias("comp"))
        rest = materialize(split_join(rest, reps.select("rep", "n"), "rep"), "rest")

        def candidates(band: int, same_block: bool, ma: list, mb: list) -> tuple[np.ndarray, ...]:
            """Members i of one block and j of the other to compare, the likeliest first."""
            ia, ca, na, ra = _unpack(ma)
            ib, cb, nb, rb = _unpack(mb)
            ok = ca[:, None] != cb[None, :]
            if same_block:
                ok &= ia[:, None] < ib[None, :]
            smaller, own = np.minimum(na[:, None], nb[None, :]), band >= BANDS
            ok &= 100 * smaller >= percent * np.maximum(na[:, None], nb[None, :])
            ok &= (smaller <= SMALL) == own  # two larger sets meet by their buckets
            agree = np.bitwise_count((ra[:, None, :] == rb[None, :, :]).view(_U)).sum(-1, dtype=np.int64)
            i, j = np.nonzero(ok & (agree >= least * REGISTERS))  # the correction only lowers an estimate
            guess = estimate(agree[i, j], na[i], nb[j], own)
            wa, wb = (_band_words(r)[:, : band % BANDS] for r in (ra, rb))
            good = (guess >= least) & ~(wa[i] == wb[j]).any(-1)  # no earlier band is shared
            i, j, guess = i[good], j[good], guess[good]
            order = np.argsort(-guess, kind="stable")
            return i[order], j[order]

        rest = self._not_lonely(rest, docs, text, doc_id)
        full = split_join(split_join(self._dealt(rest), reps.select("rep", "reg", "own"), "rep").withColumn("reg", F.when(F.col("band") < BANDS, F.col("reg")).otherwise(F.col("own"))).drop("own"), self._texts(rest.select(F.col("rep").alias("id")).distinct(), docs, text, doc_id).withColumnRenamed("id", "rep"), "rep")

        def links(batches):
            for batch in batches:
                a_out, b_out = [], []
                for _, band, xa, xb, ma, mb in zip(*(c.to_pylist() for c in batch.columns)):
                    up: dict[int, int] = {}
                    for i, j in zip(*candidates(band, xa == xb, ma, mb)):
                        ca, cb = _root(up, ma[i]["comp"]), _root(up, mb[j]["comp"])
                        if ca == cb:
                            continue
                        if _similar(_set(ma[i]["text"], k), _set(mb[j]["text"], k), percent):
                            up[ca] = cb
                            a_out.append(ma[i]["rep"]), b_out.append(mb[j]["rep"])
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

        return materialize(self._meet(full, ["rep", "comp", "n", "reg", "text"]).mapInArrow(links, "a long, b long"), "more")

    # -- confirmation ------------------------------------------------------------------------

    def _texts(self, ids: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """(id, text) of the ids, which are broadcast only after they are counted."""
        ids = materialize(ids, "ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")
        return materialize(texts.dropDuplicates(["id", "text"]), "texts")

    def _confirm(self, pairs: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """Pairs whose full sets are similar enough. Texts travel, as they are smaller than sets:
        each once for every part of up to about 64 partners, and then each partner's."""
        k, percent = self.k, self.percent
        pairs = materialize(pairs, "pairs")
        texts = self._texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, text, doc_id)
        degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).alias("parts"))
        dealt = split_join(pairs, degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        dealt = materialize(dealt, "dealt")
        heads = split_join(dealt.select("a", "part").distinct(), texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        tails = split_join(dealt, texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
        rows = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

        def run(batches):
            at, sets = None, []
            for batch in batches:
                a_out, b_out = [], []
                for a, part, b, t in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.binary())))):
                    if b is None:
                        if at != (a, part):
                            at, sets = (a, part), []
                        sets.append(textvec.shingles(t, k))
                        continue
                    h = textvec.shingles(t, k)
                    if any(_similar(s, h, percent) for s in sets):
                        a_out.append(a), b_out.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

        return materialize(rows.mapInArrow(run, "a long, b long"), "confirmed")

    # -- results -----------------------------------------------------------------------------

    def classes(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Per row: doc_id, n_shingles, component_id, kept."""
        rows = materialize(self.sketches(docs, text, doc_id), "sketches")
        known = rows.filter("n > 0 and id is not null")
        sets = materialize(known.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "sets")
        reps = known.filter(F.col("n") >= self.least).join(sets.select(F.col("rep").alias("id"), F.col("f1").alias("g1"), F.col("f2").alias("g2")), "id").filter("f1 = g1 and f2 = g2")
        reps = materialize(reps.select(F.col("id").alias("rep"), "n", "reg", "own", F.col("f1").alias("s")).dropDuplicates(["rep", "s"]).drop("s"), "reps")
        keys = lambda r, first: [F.when(F.col(r).isNotNull(), F.struct(F.lit(first + j).alias("band"), F.xxhash64(F.lit(first + j), F.substring(r, 2 * ROWS * j + 1, 2 * ROWS)).alias("key"))) for j in range(BANDS)]
        banded = reps.select("rep", F.inline(F.array_compact(F.array(*keys("reg", 0), *keys("own", BANDS)))))
        banded = banded.withColumn("turn", F.element_at(F.array(*[F.lit(x).cast("long") for x in _TURNS]), F.pmod("band", F.lit(len(_TURNS))) + 1))
        held = banded.groupBy("key", F.col("band").alias("band2")).agg(F.count(F.lit(1)).alias("size"), F.min(F.col("rep").bitwiseXOR(F.col("turn"))).alias("least")).filter("size > 1")
        met = split_join(banded, held, "key").filter("band = band2").withColumn("leader", F.col("least").bitwiseXOR(F.col("turn")))
        met = materialize(met.select("key", "band", "rep", "size", "leader"), "met")
        first = met.filter("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
        links = self._confirm(self._close(first, reps), docs, text, doc_id)
        more = self._left(met, components(links), reps, docs, text, doc_id)
        comp = components(links.unionByName(more))
        named = sets.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("f1", F.col("f2").alias("g2"), F.coalesce("c", "rep").alias("component"))
        found = split_join(rows.filter("n > 0 and id is not null"), named, "f1").filter("f2 = g2")
        alone = rows.filter("not (n > 0 and id is not null)")
        out = found.select("id", "n", "component").unionByName(alone.select("id", "n", F.col("id").alias("component")))
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

    def deduplicate(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """``docs`` with one row of each component, and the rows that have no id."""
        mark = free_name(docs, "__id")
        out = self.classes(docs, text, doc_id).filter("kept and doc_id is not null").select(F.col("doc_id").alias(mark)).distinct()
        one = docs.withColumn(mark, F.col(doc_id).cast("long")).join(out, mark).dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
        return one.unionByName(docs.filter(F.col(doc_id).isNull()))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


_sets: dict[tuple[int, str], np.ndarray] = {}
_held = [0]


def _set(text: str, k: int) -> np.ndarray:
    """The shingles of a text. A worker keeps those it had last, up to 2 million shingles, as a text meets many others."""
    h = _sets.get((k, text))
    if h is None:
        h = textvec.shingles(text.encode(), k)
        if _held[0] + len(h) > 2_000_000:
            _sets.clear()
            _held[0] = 0
        _sets[k, text] = h
        _held[0] += len(h)
    return h


def _root(up: dict[int, int], c: int) -> int:
    while c in up:
        c = up[c]
    return c


_WORD = textvec.mix(np.arange(1, ROWS + 1, dtype=_U)) | _U(1)


def _band_words(reg: np.ndarray) -> np.ndarray:
    """One number for the registers of each band."""
    return (reg[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(_U) * _WORD).sum(-1, dtype=_U)


def _unpack(members):
    reg = np.frombuffer(b"".join(m["reg"] for m in members), np.uint16).reshape(-1, REGISTERS)
    return (*(np.array([m[c] for m in members], np.int64) for c in ("rep", "comp", "n")), reg)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM reach r JOIN ends e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id, min(c) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN reach ON v = d.doc_id GROUP BY d.doc_id, n.n
"""


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return NearDuplicates(k=3, percent=85).classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
