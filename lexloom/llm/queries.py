"""The corpus queries: one for each operator, over whole tables."""

from __future__ import annotations

from lexloom.llm import fingerprint, jaccard_join, langid, line_dedup, media, mixing, packing, suffix_dedup, url_rules, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_mixing": mixing.op5_mixing,
    "op6_media": media.op6_media,
    "op7_packing": packing.op7_packing,
    "op8_language_id": langid.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

#: DuckDB SQL for the queries that it can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op1_warc": warc.OP1_SQL}
