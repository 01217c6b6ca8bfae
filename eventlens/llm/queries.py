"""Queries and SQL of the text operators, one per operator."""

from __future__ import annotations

from . import (chat_format, exact_dedup, html_text, language_id, mixing, ngram_join, packing, secrets, source_audit,
               substring_dedup, toxicity, vector_dedup, whitening)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_html_text": html_text.op6_html_text,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_embedding_neardup": vector_dedup.op8_embedding_neardup,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

#: DuckDB formulations; operators without one are tested against brute force.
ORACLE = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op8_embedding_neardup": vector_dedup.ORACLE,
    "op9_ngram_jaccard": ngram_join.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_secret_scan": secrets.ORACLE,
}
