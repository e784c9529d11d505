"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, language, line_dedup, lm_scores, near_dedup, packing, pieces, quality, ranked_search, source_audit, token_counts, tokens

QUERIES = {
    "op1_mcd_outliers": quality.op1,
    "op2_token_files": tokens.op2,
    "op3_piece_merges": pieces.op3,
    "op4_reply_trees": chat.op4,
    "op5_token_transducer": token_counts.op5,
    "op6_coordinate_join": near_dedup.op6,
    "op7_dominance_packing": packing.op7,
    "op8_piece_language": language.op8,
    "op9_backoff_scores": lm_scores.op9,
    "op10_content_sort": exact_dedup.op10,
    "op11_cuckoo_lines": line_dedup.op11,
    "op12_segment_trees": source_audit.op12,
    "op13_length_strata": ranked_search.op13,
}

SQL = {
    "op4_reply_trees": chat.OP4_SQL,
    "op9_backoff_scores": lm_scores.OP9_SQL,
    "op10_content_sort": exact_dedup.OP10_SQL,
    "op11_cuckoo_lines": line_dedup.OP11_SQL,
    "op12_segment_trees": source_audit.OP12_SQL,
    "op13_length_strata": ranked_search.OP13_SQL,
}
