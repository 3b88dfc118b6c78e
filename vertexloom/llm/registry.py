"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from vertexloom.llm import (
    op1_html_text,
    op2_exact_dedup,
    op3_secrets,
    op4_url_filter,
    op5_token_count,
    op6_quality,
    op7_simhash,
    op8_chat_format,
    op9_decontaminate,
    op10_packing,
    op11_periodic_runs,
    op12_exact_topk,
    op13_whitening,
)

QUERIES = {
    "op1_html_text": op1_html_text.op1_html_text,
    "op2_exact_dedup": op2_exact_dedup.op2_exact_dedup,
    "op3_secrets": op3_secrets.op3_secrets,
    "op4_url_filter": op4_url_filter.op4_url_filter,
    "op5_token_count": op5_token_count.op5_token_count,
    "op6_quality": op6_quality.op6_quality,
    "op7_simhash": op7_simhash.op7_simhash,
    "op8_chat_format": op8_chat_format.op8_chat_format,
    "op9_decontaminate": op9_decontaminate.op9_decontaminate,
    "op10_packing": op10_packing.op10_packing,
    "op11_periodic_runs": op11_periodic_runs.op11_periodic_runs,
    "op12_exact_topk": op12_exact_topk.op12_exact_topk,
    "op13_whitening": op13_whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_html_text": op1_html_text.SQL,
    "op2_exact_dedup": op2_exact_dedup.SQL,
    "op3_secrets": op3_secrets.SQL,
    "op4_url_filter": op4_url_filter.SQL,
    "op8_chat_format": op8_chat_format.SQL,
    "op9_decontaminate": op9_decontaminate.SQL,
    "op12_exact_topk": op12_exact_topk.SQL,
}
