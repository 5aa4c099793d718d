"""The registered queries of this subpackage, and their DuckDB oracles."""

from __future__ import annotations

from evalspark.llm import (bloom_lookup, bpe, decontaminate, hard_negatives, jaccard_join, language_id, lm_score, prefix_trie,
                           substring_dedup, suffix_dedup, token_counts, toxicity, vector_search)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_vector_search": vector_search.op2_vector_search,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_bpe": bpe.op5_bpe,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_bloom_lookup": bloom_lookup.op11_bloom_lookup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_lm_score": lm_score.OP7_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
