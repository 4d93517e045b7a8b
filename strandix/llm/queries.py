"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from strandix.llm import bpe, chat, decontaminate, html_extract, language_id, line_dedup, ngram_join, quality, sharding, token_counts

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_language_id": language_id.op2_language_id,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_chat_format": chat.op5_chat_format,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES = {
    "op1_sharding": sharding.sql(),
    "op4_decontamination": decontaminate.SQL,
    "op5_chat_format": chat.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
