"""The registered queries of the training-data operators."""

from __future__ import annotations

from docloom.llm import fingerprints, language_model, mixing, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_store, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_token_store": token_store.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_source_mixing": mixing.op5,
    "op6_language_model": language_model.op6,
    "op7_simhash_dedup": simhash_dedup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_pattern_packing": packing.op10,
}
ORACLE_SQL = {"op1_substring_dedup": substring_dedup.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op5_source_mixing": mixing.ORACLE}
