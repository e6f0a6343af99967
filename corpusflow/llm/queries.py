"""Queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, ctw, host_rules, jaccard, lines, negatives, packing, quality, repair, token_counts, toxicity, winnowing

QUERIES = {
    "op1_document_fingerprints": winnowing.op1_document_fingerprints,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_lm_scoring": ctw.op6_lm_scoring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_host_rules": host_rules.op9_host_rules,
    "op10_bpe": bpe.op10_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_chat_formatting": chat.op13_chat_formatting,
}
ORACLE_SQL: dict[str, str] = {
    "op9_host_rules": host_rules.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
    "op13_chat_formatting": chat.OP13_SQL,
}
