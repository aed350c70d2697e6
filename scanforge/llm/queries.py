"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from scanforge.llm import (
    op1_exact_dedup,
    op2_language_id,
    op3_jaccard_join,
    op4_sharding,
    op5_mixing,
    op6_repeats,
    op7_sentencepiece,
    op8_packed_ids,
    op9_quality,
    op10_line_dedup,
    op11_alignment,
    op12_lexical_search,
    op13_minhash_dedup,
)

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup.op1_exact_dedup,
    "op2_language_id": op2_language_id.op2_language_id,
    "op3_jaccard_join": op3_jaccard_join.op3_jaccard_join,
    "op4_sharding": op4_sharding.op4_sharding,
    "op5_mixing": op5_mixing.op5_mixing,
    "op6_repeats": op6_repeats.op6_repeats,
    "op7_sentencepiece": op7_sentencepiece.op7_sentencepiece,
    "op8_packed_ids": op8_packed_ids.op8_packed_ids,
    "op9_compression_bands": op9_quality.op9_compression_bands,
    "op10_line_dedup": op10_line_dedup.op10_line_dedup,
    "op11_alignment": op11_alignment.op11_alignment,
    "op12_lexical_search": op12_lexical_search.op12_lexical_search,
    "op13_minhash_dedup": op13_minhash_dedup.op13_minhash_dedup,
}

SQL = {
    "op1_exact_dedup": op1_exact_dedup.ORACLE,
    "op10_line_dedup": op10_line_dedup.ORACLE,
    "op12_lexical_search": op12_lexical_search.ORACLE,
}
