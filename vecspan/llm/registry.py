"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from vecspan.llm import chat_format, decontaminate, html_text, line_dedup, packing, quality_rules, simhash, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op1_packing": packing.op1_packing,
    "op9_simhash": simhash.op9_simhash,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op6_chat_format": chat_format.OP6_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
