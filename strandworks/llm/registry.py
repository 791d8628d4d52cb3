"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import langid, linedup, manifest, media, mixing, packing, repair, riskrules, simhash, substring, tokenfiles, toxicity, winnow


def queries() -> dict:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_simhash": simhash.op3_simhash,
        "op4_winnowing": winnow.op4_winnowing,
        "op5_packing": packing.op5_packing,
        "op6_token_shards": tokenfiles.op6_token_shards,
        "op7_language_id": langid.op7_language_id,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_line_dedup": linedup.op10_line_dedup,
        "op11_quality_rules": riskrules.op11_quality_rules,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring.OP2_SQL, "op10_line_dedup": linedup.OP10_SQL, "op11_quality_rules": riskrules.OP11_SQL, "op12_conversation_repair": repair.OP12_SQL, "op13_merkle_manifest": manifest.OP13_SQL}
