"""Queries of this subpackage, and their SQL where DuckDB can say it."""

from __future__ import annotations

from . import chat, decontam, fuzzy_lines, line_quality, near_dup, packing, pii, shards, suffix_dedup, url_rules

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.query,
    "op2_pii_disclosure": pii.query,
    "op3_chat_quotation": chat.query,
    "op4_url_filters": url_rules.query,
    "op5_quality_rules": line_quality.query,
    "op6_near_duplicates": near_dup.query,
    "op7_fuzzy_line_dedup": fuzzy_lines.query,
    "op8_decontamination": decontam.query,
    "op9_packing": packing.query,
    "op10_sharding": shards.query,
}
SQL = {"op3_chat_quotation": chat.SQL, "op4_url_filters": url_rules.SQL, "op5_quality_rules": line_quality.SQL}
