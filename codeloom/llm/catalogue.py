"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from codeloom.llm import chat_format, conversation_repair, decontaminate, divergence, exact_dedup, jaccard_join, language_id, minhash, piece_codec, sharding, suffix_dedup, token_count, toxicity

QUERIES = {
    "op1_piece_codec": piece_codec.op1_piece_codec,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}
#: Queries that learn from data or run a tokenizer have no SQL; tests/llm holds them against brute force.
ORACLES = {
    "op4_sharding": sharding.oracle(),
    "op6_chat_format": chat_format.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_minhash_dedup": minhash.ORACLE,
}
