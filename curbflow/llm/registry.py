"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from curbflow.llm import language, main_text, near_duplicates, neighbours, packing, pieces, quality_model, quality_rules, sharding, toxicity


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_main_text": main_text.op2_main_text,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_simhash": near_duplicates.op4_simhash,
        "op5_pieces": pieces.op5_pieces,
        "op6_quality": quality_model.op6_quality,
        "op7_language": language.op7_language,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql():
    return {"op1_sharding": sharding.ORACLE}
