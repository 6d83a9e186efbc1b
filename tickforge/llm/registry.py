"""The queries of this package and their SQL."""

from __future__ import annotations

from tickforge.llm import bpe, language_id, mixing, near_dup, pii, prefix_trie, quality_classifier, quality_rules, resampling, secrets, substring_dup, suffix_dup, vector_dup

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_bpe": bpe.query,
    "op3_language_id": language_id.query,
    "op4_vector_dup": vector_dup.query,
    "op5_suffix_dup": suffix_dup.query,
    "op6_secrets": secrets.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_substring_dup": substring_dup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_near_dup": near_dup.query,
    "op11_pii": pii.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_resampling": resampling.query,
}

SQL = {
    "op4_vector_dup": vector_dup.SQL,
    "op8_substring_dup": substring_dup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op10_near_dup": near_dup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_resampling": resampling.SQL,
}
