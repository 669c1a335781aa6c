"""Registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from linecast.llm import bm25, classlm, codebooks, decontam, fingerprints, mixing, neardup, negatives, perspectives, sharding, substrings, toxicity, wrapper

QUERIES = {
    "op1_wrapper_extraction": wrapper.op1_wrapper_extraction,
    "op2_perspective_rotation": perspectives.op2_perspectives,
    "op3_temperature_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": substrings.op4_suffix_dedup,
    "op5_bm25_topk": bm25.op5_bm25,
    "op6_brown_class_lm": classlm.op6_class_lm,
    "op7_superminhash_neardup": neardup.op7_near_duplicates,
    "op8_ftrl_toxicity": toxicity.op8_toxicity,
    "op9_extendible_sharding": sharding.op9_sharding,
    "op10_benchmark_decontamination": decontam.op10_decontaminate,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_vector_codes": codebooks.op12_vector_codes,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op2_perspective_rotation": perspectives.ORACLE_OP2,
    "op4_suffix_dedup": substrings.ORACLE_OP4,
    "op5_bm25_topk": bm25.ORACLE_OP5,
    "op7_superminhash_neardup": neardup.ORACLE_OP7,
    "op9_extendible_sharding": sharding.ORACLE_OP9,
    "op10_benchmark_decontamination": decontam.ORACLE_OP10,
    "op12_vector_codes": codebooks.ORACLE_OP12,
    "op13_hard_negatives": negatives.ORACLE_OP13,
}
