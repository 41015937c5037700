"""The queries of this package (``opN_<name>``) and their DuckDB oracles."""

from __future__ import annotations

from shardlens.llm import (bpe, code_search, collocations, html_text, jaccard_join, lexical_search, mixing, phrase_dedup,
                           quality_outliers, sharding, suffix_dedup, toxicity, vector_links)

QUERIES = {
    "op1_soft_mixing": mixing.op1_soft_mixing,
    "op2_tree_scored_html": html_text.op2_tree_scored_html,
    "op3_backtracking_bpe": bpe.op3_backtracking_bpe,
    "op4_nnpu_toxicity": toxicity.op4_nnpu_toxicity,
    "op5_phrase_automata": phrase_dedup.op5_phrase_automata,
    "op6_rendezvous_sharding": sharding.op6_rendezvous_sharding,
    "op7_multi_index_search": code_search.op7_multi_index_search,
    "op8_run_length_dedup": suffix_dedup.op8_run_length_dedup,
    "op9_collision_counting": vector_links.op9_collision_counting,
    "op10_size_banded_jaccard": jaccard_join.op10_size_banded_jaccard,
    "op11_trie_collocations": collocations.op11_trie_collocations,
    "op12_mcd_outliers": quality_outliers.op12_mcd_outliers,
    "op13_nra_search": lexical_search.op13_nra_search,
}

ORACLES = {
    "op6_rendezvous_sharding": sharding.ORACLE_SQL,
    "op7_multi_index_search": code_search.ORACLE_SQL,
    "op9_collision_counting": vector_links.ORACLE_SQL,
    "op11_trie_collocations": collocations.ORACLE_SQL,
    "op13_nra_search": lexical_search.ORACLE_SQL,
}
