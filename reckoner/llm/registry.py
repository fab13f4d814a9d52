"""The registered queries of the corpus operators."""

from __future__ import annotations

from reckoner.llm import chat, embeddings, jaccard, lexical, media_ts, negatives, oracles, packing, pieces, pii, quality, substring, token_files, toxicity

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_transport_streams": media_ts.op2_transport_streams,
    "op3_toxic_spans": toxicity.op3_toxic_spans,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_embedding_forest": embeddings.op5_embedding_forest,
    "op6_line_quality": quality.op6_line_quality,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_sampled_pieces": pieces.op9_sampled_pieces,
    "op10_token_files": token_files.op10_token_files,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_typed_chats": chat.op13_typed_chats,
}

#: The other queries depend on models, vocabularies or formats that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = {
    "op4_substring_dedup": oracles.SUBSTRING,
    "op5_embedding_forest": oracles.EMBEDDINGS,
    "op7_jaccard_join": oracles.JACCARD,
    "op11_hard_negatives": oracles.NEGATIVES,
    "op12_lexical_search": oracles.LEXICAL,
    "op13_typed_chats": oracles.CHATS,
}
