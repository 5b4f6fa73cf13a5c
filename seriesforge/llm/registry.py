"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from seriesforge.llm import bpe, divergence, filter_audit, html_extract, mixing, near_dedup, ngram_join, quality, sharding, substring_dedup, token_counts, topk, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_topk": topk.op10_topk,
    "op11_divergence": divergence.op11_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL = {"op7_sharding": sharding.OP7_SQL, "op10_topk": topk.OP10_SQL, "op11_divergence": divergence.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_warc": warc.OP13_SQL}
