"""Registry of the subpackage's queries: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from risklens.llm import chat_tree, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, minhash_dedup, periodic_runs, phrases, pieces, token_counts, url_filters, zip_warc

QUERIES = {
    "op1_sentencepiece": (pieces.query, None),
    "op2_language_id": (language_id.query, None),
    "op3_chat_tree": (chat_tree.query, chat_tree.SQL),
    "op4_url_filters": (url_filters.query, url_filters.SQL),
    "op5_exact_dedup": (exact_dedup.query, exact_dedup.SQL),
    "op6_token_counts": (token_counts.query, None),
    "op7_zip_warc": (zip_warc.query, None),
    "op8_jaccard_join": (jaccard_join.query, None),
    "op9_line_dedup": (line_dedup.query, None),
    "op10_decontaminate": (decontaminate.query, None),
    "op11_minhash_dedup": (minhash_dedup.query, None),
    "op12_periodic_runs": (periodic_runs.query, None),
    "op13_phrases": (phrases.query, phrases.SQL),
}
