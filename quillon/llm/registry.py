"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversations, lines, media, mixing, near_dups, personal, pieces, quality, resampling, scoring, substrings, token_files, topk


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_token_files": token_files.op3_token_files,
        "op4_near_dups": near_dups.op4_near_dups,
        "op5_substring_dedup": substrings.op5_substring_dedup,
        "op6_media": media.op6_media,
        "op7_lm_scoring": scoring.op7_lm_scoring,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_topk": topk.op9_topk,
        "op10_mixing": mixing.op10_mixing,
        "op11_personal": personal.op11_personal,
        "op12_conversations": conversations.op12_conversations,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.SQL, "op4_near_dups": near_dups.SQL, "op5_substring_dedup": substrings.SQL, "op9_topk": topk.SQL, "op10_mixing": mixing.sql(), "op12_conversations": conversations.SQL, "op13_resampling": resampling.SQL}
