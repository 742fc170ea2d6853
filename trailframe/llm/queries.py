"""Registered queries of the subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from trailframe.llm import byte_bpe, chat_format, decontamination, html_extract, kneser_ney, language_id, nearest_vectors, ngram_join, periodic_runs, phrase_dedup, quality_rules, spelling_variants, token_counts

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_quality_forest": quality_rules.op3_quality_forest,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language_id": language_id.op5_language_id,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_phrase_dedup": phrase_dedup.op7_phrase_dedup,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_kneser_ney": kneser_ney.op9_kneser_ney,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_nearest_vectors": nearest_vectors.op13_nearest_vectors,
}

ORACLE_SQL = {
    "op6_chat_format": chat_format.OP6_SQL,
    "op7_phrase_dedup": phrase_dedup.OP7_SQL,
    "op8_ngram_jaccard": ngram_join.OP8_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op12_spelling_variants": spelling_variants.OP12_SQL,
}
