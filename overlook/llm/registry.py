"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, embedding_dedup, fingerprints, language_id, lexical_search, ngram_join, packing, piece_codec, secret_scan, source_mixing, substring_dedup, toxicity, vector_codes

QUERIES = {
    "op1_packing": packing.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_piece_codec": piece_codec.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_chat_format": chat_format.query,
    "op6_toxicity": toxicity.query,
    "op7_language_id": language_id.query,
    "op8_ngram_join": ngram_join.query,
    "op9_fingerprints": fingerprints.query,
    "op10_secret_scan": secret_scan.query,
    "op11_vector_codes": vector_codes.query,
    "op12_source_mixing": source_mixing.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES: dict[str, str] = {
    "op5_chat_format": chat_format.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_source_mixing": source_mixing.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
