"""Queries and oracle SQL of this package."""

from __future__ import annotations

import corpus_pipeline
from joinwright.llm import decontamination, language_id, near_dedup, piece_lattice, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_sharding": sharding.op6_sharding,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_language_id": language_id.op8_language_id,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_piece_lattice": piece_lattice.op10_piece_lattice,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup.ORACLE,
        "op3_quality_rules": quality_rules.ORACLE,
        "op6_sharding": sharding.ORACLE,
        "op9_near_dedup": near_dedup.ORACLE,
    }
