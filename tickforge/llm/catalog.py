"""The registered corpus queries and their oracle SQL."""

from __future__ import annotations

from tickforge.llm import chat, language_id, line_dedup, mixing, ngram_join, packing, sharding, url_filter, vector_dedup, vector_search

QUERIES = {
    "op1_embedding_near_dedup": vector_dedup.op1_embedding_near_dedup,
    "op2_nearest_neighbours": vector_search.op2_nearest_neighbours,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_language_id": language_id.op5_language_id,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op9_sharding": sharding.op9_sharding,
    "op10_chat_formatting": chat.op10_chat_formatting,
}
ORACLES = {
    "op1_embedding_near_dedup": vector_dedup.ORACLE,
    "op4_url_filters": url_filter.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op8_ngram_jaccard_join": ngram_join.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
