"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from pixelhour.llm import (
    binary_packing, byte_bpe, conversations, exact_dedup, fingerprints, hard_negatives, hmm, language_id, mixing, near_dedup, personal_data,
    quality, sharding,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_hmm": hmm.op6_hmm,
    "op7_quality": quality.op7_quality,
    "op8_language_id": language_id.op8_language_id,
    "op9_personal_data": personal_data.op9_personal_data,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_conversations": conversations.op11_conversations,
    "op12_binary_packing": binary_packing.op12_binary_packing,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op11_conversations": conversations.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
