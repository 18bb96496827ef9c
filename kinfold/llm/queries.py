"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from kinfold.llm import ann, jaccard, lm_score, mixing, packing, quality_fm, quality_rules, sharding, substring, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_lm_scoring": lm_score.query,
    "op3_sharding": sharding.query,
    "op4_mixing": mixing.query,
    "op5_substring_dedup": substring.query,
    "op6_quality_classifier": quality_fm.query,
    "op7_quality_rules": quality_rules.query,
    "op8_toxicity": toxicity.query,
    "op9_nearest_neighbours": ann.query,
    "op10_packing": packing.query,
}

SQL = {
    "op1_ngram_jaccard_join": jaccard.SQL,
    "op2_lm_scoring": lm_score.SQL,
    "op3_sharding": sharding.SQL,
    "op4_mixing": mixing.SQL,
    "op5_substring_dedup": substring.SQL,
}
