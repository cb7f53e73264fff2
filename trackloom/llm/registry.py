"""The corpus queries, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from trackloom.llm import bpe, chat_format, exact_dedup, fill_middle, filter_audit, html_consensus, jaccard_join, language_gru, packing, pii, quality_conv, simhash, topk_search

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_simhash": simhash.op2_simhash,
    "op3_language_gru": language_gru.op3_language_gru,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_bpe_chunk_reuse": bpe.op7_bpe_chunk_reuse,
    "op8_quality_conv": quality_conv.op8_quality_conv,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_html_consensus": html_consensus.op10_html_consensus,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_topk_search": topk_search.op12_topk_search,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_topk_search": topk_search.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
