"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from . import chat_format, embedding_dedup, jaccard_join, language_id, lm_scoring, mixing, packing, phrases, quality_rules, substring_dedup, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.query,
    "op2_quality_rules": quality_rules.query,
    "op3_chat_format": chat_format.query,
    "op4_embedding_near_dedup": embedding_dedup.query,
    "op5_best_fit_packing": packing.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_lm_scoring": lm_scoring.query,
    "op8_source_mixing": mixing.query,
    "op9_toxicity": toxicity.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_embedding_whitening": whitening.query,
    "op12_language_id": language_id.query,
    "op13_phrase_mining": phrases.query,
}
ORACLES = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_chat_format": chat_format.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op13_phrase_mining": phrases.SQL,
}
