"""The registered queries of the dealt operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality_rules, recompression_dedup, sentencepiece_codec, source_divergence, suffix_dedup, token_alignment, token_output

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_ngram_join": ngram_join.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_token_output": token_output.query,
    "op5_quality_rules": quality_rules.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_mixing": mixing.query,
    "op9_language_id": language_id.query,
    "op10_recompression_dedup": recompression_dedup.query,
    "op11_source_divergence": source_divergence.query,
    "op12_token_alignment": token_alignment.query,
    "op13_chat_format": chat_format.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_ngram_join": ngram_join.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_recompression_dedup": recompression_dedup.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
