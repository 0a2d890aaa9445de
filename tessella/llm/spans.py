"""Substring dedup by sliding sentence spans.

A text is cut into sentences, at line ends and after closing punctuation; within a sentence every run of ``PIECE``
words is cut after the word with the least hash (the first of equal ones), so that one long sentence has spans
too, wherever a passage begins in it, and a passage is cut alike in every sentence that holds it. A span is a run of consecutive sentences: from each sentence
on the shortest run of ``LEAST_SENTENCES`` or more with ``LEAST_WORDS`` or more words, and the same
backwards to each sentence, so that a repeated passage is covered up to both of its ends. Spans
are hashed over their words (lower case) and joined over the whole corpus, and sentences that lie in any
occurrence but the first of a repeated span are removed. The first is in the document with the
least id, at its first place there.

Repeats within a document are found beside its text. Each other span is counted once a document;
the least ids are found where texts are read before rows are dealt by hash, so a passage that a third of all
documents share comes to its reducer as one row per task, and its occurrences meet the result in a
join whose hot partitions can be cut. Only spans that may repeat travel to that join: those whose hash finds its bit
set among the bits of all repeated hashes, of which there are ``MOST_BITS`` at most. A bit too many costs a row
in the join, which decides.

Defined results: null text stays null and has no sentences; texts of less than a span stay
as they are; rows with one id count as one document, so repeated rows all keep what the first
keeps; rows with a null id come after all others (of ids below 2**62), in an order by hash, those of one text as one document;
an empty table gives an empty table. Spans count as equal if their 64-bit hashes are.
Columns of the input stay; ``n_removed`` gets underscores where taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import textvec
from tessella.llm.common import discard, free_name, materialize, split_join

LEAST_SENTENCES, LEAST_WORDS, PIECE = 3, 25, 12
#: Bits of a set of hashes, 16 for each up to this many (16 MiB).
MOST_BITS = 1 << 27
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_U = np.uint64


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, first words, word hashes) of the sentences; a start is the
    end of the one before, so that they tile the text from its first word on."""
    h, s, e = textvec.words(text, lower=True)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, h
    b = np.frombuffer(text, np.uint8)
    line = np.searchsorted(np.flatnonzero(b == 10), s)
    first = np.concatenate([[0], np.flatnonzero(_STOP[b[e[:-1] - 1]] | (line[1:] > line[:-1])) + 1])
    if len(h) >= PIECE and (np.diff(np.append(first, len(h))) >= PIECE).any():
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        at = np.flatnonzero(of[: len(h) - PIECE + 1] == of[PIECE - 1 :])  # runs within one sentence
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            least = part + np.lib.stride_tricks.sliding_window_view(h, PIECE)[part].argmin(1)
            first = np.union1d(first, least + 1)
        first = first[first < len(h)]
    starts = s[first]
    return starts, np.append(starts[1:], len(text)), first, h


def runs(first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last sentence of each span."""
    n = len(first)
    bounds = np.append(first, n_words)
    i = np.arange(n)
    ahead = np.maximum(np.searchsorted(bounds, bounds[:-1] + LEAST_WORDS), i + LEAST_SENTENCES)
    back = np.minimum(np.searchsorted(bounds, bounds[1:] - LEAST_WORDS, side="right") - 1, i + 1 - LEAST_SENTENCES)
    a = np.concatenate([i[ahead <= n], back[back >= 0]])
    b = np.concatenate([ahead[ahead <= n], i[back >= 0] + 1])
    if not len(a):
        return a, b
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def span_hashes(first: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words of spans: a sum that doesn't depend on where the span lies."""
    p, q = textvec._power(len(h) + 1)
    c = np.zeros(len(h) + 1, _U)
    np.cumsum(h * p[: len(h)], out=c[1:])
    bounds = np.append(first, len(h))
    s, e = bounds[a], bounds[b]
    return textvec.mix((c[e] - c[s]) * q[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))


def found(text: bytes) -> tuple[np.ndarray, ...]:
    """(starts, ends, a, b, hashes, again): sentences, spans, and which spans repeat one before
    them in this text."""
    starts, ends, first, h = sentences(text)
    a, b = runs(first, len(h))
    hashes = span_hashes(first, h, a, b) if len(a) else h[:0]
    again = np.ones(len(a), bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    return starts, ends, a, b, hashes, again


def _span_rows(batches):
    """(h, id, row, a, b, again) of every span."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):  # so that a batch of long texts makes several small ones
            part = batch.slice(i, 64)
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for d, r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                _, _, a, b, h, again = found(t or b"")
                for c, v in zip(cols, (h.view(np.int64), np.full(len(a), d, np.int64), np.full(len(a), r, np.int64), a, b, again)):
                    c.append(v)
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)], names=["h", "id", "row", "a", "b", "again"])


def bits_of(hashes: DataFrame) -> np.ndarray:
    """Words of 64 bits in which every h of ``hashes`` has its bit set."""
    words = 1 << (max(1 << 10, min(MOST_BITS, 16 * hashes.count()) // 64) - 1).bit_length()
    word, bit = F.shiftright("h", 6).bitwiseAND(F.lit(words - 1)), F.expr("shiftleft(1L, cast(h & 63 AS int))")
    got = hashes.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, _U)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(_U)
    return out


def may_hold(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose h, the first column, finds its bit set."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy()
            word = held.value[(h >> 6) & (len(held.value) - 1)]
            yield batch.filter(pa.array((word >> (h & 63).astype(_U)) & _U(1) != 0))

    return rows.mapInArrow(run, rows.schema)


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, spans): by a hash of id and text, the (a, b) of sentences that an earlier document
    has, or an earlier place of the same one."""
    late = F.xxhash64(F.col(text).cast("string")).bitwiseAND((1 << 61) - 1) + F.lit(1 << 62)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), late).alias("id"), F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))
    spans = materialize(rows.mapInArrow(_span_rows, "h long, id long, row long, a int, b int, again boolean"), "spans")
    once = spans.filter("not again").drop("again")
    per = materialize(once.groupBy("h").agg(F.min("id").alias("id0"), F.max("id").alias("id1")).filter("id0 < id1").select("h", "id0"), "firsts")
    hit = split_join(may_hold(once, bits_of(per)), per, "h").filter("id > id0").select("row", "a", "b").unionByName(spans.filter("again").select("row", "a", "b"))
    known = materialize(hit.groupBy(F.col("row").alias("key")).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "repeats")
    discard(spans), discard(per)
    return known


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(the text without the sentences of the spans, sentences removed)."""
    starts, ends, _, _ = sentences(text)
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    left = b"".join([text[: starts[0]], *(text[starts[i] : ends[i]] for i in np.flatnonzero(~gone))])
    return left, int(gone.sum())


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the text cut, and n_removed."""
    key = F.xxhash64(F.col(doc_id), F.col(text).cast("string"))
    known = repeated(docs, text, doc_id)
    mark, held = free_name(docs, "__key"), free_name(docs, "__spans")
    joined = docs.withColumn(mark, key).join(known.select(F.col("key").alias(mark), F.col("spans").alias(held)), mark, "left")
    name, at = free_name(docs, "n_removed"), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for t, spans in zip(batch.column(at).cast(pa.string()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                n = 0
                if spans:
                    left, n = cut(t.encode(), [(s["a"], s["b"]) for s in spans])
                    t = left.decode()
                texts.append(t), removed.append(n)
            cols = [*batch.columns[:-1], pa.array(removed, pa.int64())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], held).mapInArrow(run, schema)


def op6_spans(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
