"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from strandline.llm import ann_forest, byte_bpe, chat, jaccard_join, language_id, line_dedup, media, packing, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_ann_forest": ann_forest.op4_ann_forest,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_language_id": language_id.op7_language_id,
        "op8_preference_chat": chat.op8_preference_chat,
        "op9_media_columns": media.op9_media_columns,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op5_jaccard_join": jaccard_join.OP5_SQL,
        "op8_preference_chat": chat.OP8_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
    }
