"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessella.llm import decontam, html_extract, mixing, neardup, quality, secrets, sharding, spans, tokens, urls

QUERIES = {
    "op1_html": html_extract.op1_html,
    "op2_mixing": mixing.op2_mixing,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_neardup": neardup.op5_neardup,
    "op6_spans": spans.op6_spans,
    "op7_decontam": decontam.op7_decontam,
    "op8_urls": urls.op8_urls,
    "op9_sharding": sharding.op9_sharding,
    "op10_tokens": tokens.op10_tokens,
}

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op3_secrets": secrets.ORACLE,
    "op5_neardup": neardup.ORACLE,
    "op7_decontam": decontam.ORACLE,
    "op9_sharding": sharding.ORACLE,
}
