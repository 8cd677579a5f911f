"""The queries of this subpackage, and their SQL where DuckDB can express one."""

from __future__ import annotations

from . import chat, decontaminate, html_text, language_id, media, packing, quality, simhash, token_counts, token_orc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_packing": packing.op3_packing,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_token_orc": token_orc.op5_token_orc,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_media_columns": media.op8_media_columns,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

#: The other operators' results are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = {"op2_chat_format": chat.OP2_SQL}
