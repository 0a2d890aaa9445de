"""Token counts by offset-mapped attribution.

A document is encoded whole, once. The lengths of its tokens in bytes give each token's span of
characters; spans are joined to the intervals of sections, and a token that crosses a boundary is
counted once, by the rule: ``start`` gives it to the section that holds its first character,
``most`` to the one that holds most of its characters (of equals the earlier). Tokens that touch no section
are counted as outside.

The vocabulary is a file of byte-pair ranks, a parameter; the driver reads it and sends its bytes
(a fixed size) to the executors.

Defined results: null or empty text has no tokens and, by lines, no sections; sections are cut to
the text, and empty ones get no tokens; where sections overlap the one that starts first (then the first in order) takes
a token; repeated rows give equal counts; an empty table gives an empty table. Columns of
the input stay; new ones get underscores where taken.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import free_name

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "most")
_loaded: dict[int, tuple] = {}


def encoder(vocabulary: bytes):
    """(encode, byte length of each id) of a file of ranks; one for each process."""
    key = hash(vocabulary)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _loaded[key] = tiktoken.Encoding(f"ranks-{key}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size
    return _loaded[key]


def token_spans(text: str, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token; a token of part of a character spans it."""
    encode, size = encoder(vocabulary)
    ends = np.cumsum(size[np.asarray(encode(text), np.int64)]) if text else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    return (lead[starts] - 1, lead[ends - 1]) if len(ends) else (starts, ends)


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines that hold something, without their ends."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "start") -> tuple[np.ndarray, int, int]:
    """(tokens by section, crossing, outside). Crossing: tokens that touch two sections, or one and
    what is outside."""
    counts = np.zeros(len(sections), np.int64)
    if not len(starts) or not sections:
        return counts, 0, len(starts)
    order = sorted(range(len(sections)), key=lambda i: (sections[i][0], i))
    lo = np.array([sections[i][0] for i in order])
    hi = np.array([max(sections[i]) for i in order])
    # overlaps go to the earlier section: from here on intervals are disjoint and sorted
    lo = np.maximum(lo, np.concatenate([[0], np.maximum.accumulate(hi)[:-1]]))
    some = hi > lo
    if not some.any():
        return counts, 0, len(starts)
    order, lo, hi = np.array(order)[some], lo[some], hi[some]
    first = np.searchsorted(hi, starts, side="right")  # the first interval that ends behind the token's start
    last = np.searchsorted(lo, ends, side="left") - 1  # the last that starts before its end
    touches = last >= first
    inside = touches & (lo[np.minimum(first, len(lo) - 1)] <= starts) & (hi[np.minimum(first, len(lo) - 1)] >= ends)
    if rule == "start":
        at = np.minimum(first, len(lo) - 1)
        holds = touches & (lo[at] <= starts)
        choice = np.where(holds, at, -1)
    elif rule == "most":
        choice = np.where(inside, first, -1)
        for t in np.flatnonzero(touches & ~inside):
            parts = np.arange(first[t], last[t] + 1)
            over = np.minimum(hi[parts], ends[t]) - np.maximum(lo[parts], starts[t])
            if over.max() > 0:
                choice[t] = parts[int(over.argmax())]
    else:
        raise ValueError(f"rule is one of {RULES}")
    got = np.bincount(choice[choice >= 0], minlength=len(order))
    counts[order] = got
    return counts, int((touches & ~inside).sum()), int((choice < 0).sum())


def count_tokens(docs: DataFrame, text: str = "text", sections: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens, n_sections, n_crossing, n_outside and section_tokens (an array, by section).

    ``sections``: a column of arrays of (start, end) in characters; the lines of the text without it.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [free_name(docs, n) for n in ("n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens")]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names[:4]], T.StructField(names[4], T.ArrayType(T.LongType()))])
    at = docs.columns.index(text)
    by = docs.columns.index(sections) if sections else None

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            texts = batch.column(at).cast(pa.string()).to_pylist()
            cuts = batch.column(by).to_pylist() if by is not None else [None] * len(texts)
            for t, cut in zip(texts, cuts):
                t = t or ""
                s, e = token_spans(t, ranks.value)
                where = line_sections(t) if by is None else [tuple(x.values())[:2] for x in cut or ()]
                counts, crossing, outside = allocate(s, e, where, rule)
                for o, v in zip(out, (len(s), len(where), crossing, outside, counts)):
                    o.append(v)
            cols = [*batch.columns, *[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, schema)


def count_fields(rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each field when the fields are joined to one document and that is encoded whole."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    text, cuts = free_name(rows, "joined"), free_name(rows, "cuts")
    ends, spans = F.lit(0), []
    for p in parts:
        spans.append(F.struct(ends.alias("start"), (ends + F.length(p)).alias("end")))
        ends = ends + F.length(p) + len(separator)
    full = rows.withColumn(text, F.concat_ws(separator, *parts)).withColumn(cuts, F.array(*spans))
    return count_tokens(full, text, cuts, rule, vocabulary).drop(text, cuts)


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    from tessella.session import table

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
